"""Word lists, patterns and numbers of the record model. Results depend on them, so they stand as they are."""

from __future__ import annotations

STOPWORDS = tuple("""a about after all an and are as at be been but by for from had has have he her him his i in is it its me not
of on or she that the their them then there they this to up was were with you your""".split())

NAME_STOPWORDS = tuple("""Chapter Part Prologue Epilogue Interlude One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve
Thirteen Fourteen Fifteen Sixteen Seventeen Eighteen Nineteen Twenty Thirty Forty Fifty January February March April May June July
August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday English French Spanish German
Italian Japanese Chinese Source Target Memo Note Editor Author Title God Lord Christ Jesus Buddha Oh Ok Okay Yeah Yep Nope No Yes
Hey Hi Hello""".split())

ENGLISH_MARKERS = tuple("and chapter for had he her him his it july said she that the this was were with you".split())
FRENCH_MARKERS = tuple("""avec ce chapitre dans de des du elle elles en est et il ils je juillet la le les lui mais ne nous pas
pour que qui se tu un une vous""".split())

KNOWN_TERMS = {
    "boyfriend": "petit ami", "carbs": "glucides", "chapter": "chapitre", "hockey": "hockey",
    "parking lot": "parking", "playoffs": "playoffs", "shorts": "short", "trail": "sentier",
}

MARKER_HINTS = {
    "healthy": (r"\bsains?\b", r"\bbon(?:s|nes)?\b"),
    "smoke": (r"\bfumes?\b", r"\bfumez\b", r"\bfumer\b"),
    "last night": (r"\bhier soir\b", r"\bla nuit derni[eè]re\b"),
    "now": (r"\bmaintenant\b",),
    "real": (r"\bvrai(?:e|s|es)?\b", r"\br[eé]el(?:le|s|les)?\b"),
    "that": (r"\b[cç]a\b", r"\bcela\b", r"\bce\b", r"\bcette\b"),
}

BLOCK_TAGS = tuple("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p td th".split())
SKIP_INSIDE = tuple("script style svg math".split())
INLINE_TAGS = tuple("b em i strong".split())
NON_STORY = tuple("about acknowledg booklist contents copyright cover dedication excerpt intro introduction teaser title toc".split())

ONES = tuple("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen""".split())
TENS = tuple("twenty thirty forty fifty sixty seventy eighty ninety".split())

PROMPT_LEAKS = ("English:", "French:", "Translate the following", "Return only", "Here is", "<|im_start|>", "<|im_end|>")

KEYBOARD = {
    " ": " ", " ": " ", "©": "(c)", "«": '"', "­": "-", "®": "(r)", "»": '"', "‐": "-", "‑": "-", "‒": "-",
    "–": "-", "—": "-", "―": "-", "‘": "'", "’": "'", "‚": ",", "‛": "'", "“": '"', "”": '"', "„": '"', "•": "-",
    "…": "...", "′": "'", "″": '"', "€": "EUR", "™": "(tm)", "←": "<-", "→": "->", "⇒": "=>", "✓": "[OK]", "✔": "[OK]",
    "❌": "[FAIL]", "⚠": "[WARN]", "⟦": "[[", "⟧": "]]", "×": "x",
}

SPEECH_VERBS = "said|asked|called|shouted|whispered|muttered|snapped|replied|answered|laughed|continued|told|yelled|groaned|huffed|wheezed"
PAST_NARRATION = "was|were|had|felt|looked|smiled|laughed|said|asked|called|reached|collapsed|stumbled|put|waited|opened|pulled|closed|tilted|tried|grabbed|rolled|dropped|sprang|gave|wanted"
PRESENT_DRIFT = "s'essuie|essuie|tient|regarde|sourit|rit|ouvre|ferme|demande|repond|répond|dit|pense|sait|veut|peut|attrape|tombe|se lève|lève|marche|court|parle|crie|chuchote"
SECOND_PERSON = "you|your|yours|yourself|you're|you've|you'll|you'd"
PLURAL_OR_FORMAL = "you guys|both of you|all of you|you two|the two of you|with both of you|for both of you|between you|your side"

LEAK_WORDS = tuple("""the a an is are was were be been being have has had do does did will would could should may might must shall
ought you your yours yourself him her his hers them their theirs who what which when where why how much many some any all but and or
nor yet so because though although however therefore oh well just like okay yeah no yes shut up let go""".split())
LEAK_EXEMPT = tuple("a an or so no".split())
DIALOGUE_ENGLISH = tuple("""the you your is are was were have has had will would could should just like so not don't can't won't
didn't doesn't i'm i'll i've shut up let go come on right okay no way that's it's what's""".split())

EMOTIONS = {
    "anger": "angry rage fury furious hate hatred hostile violent scream curse damn",
    "fear": "afraid fear scared terror panic dread horror nightmare threat warning",
    "joy": "happy joy delight laugh smile love wonderful beautiful bliss ecstatic",
    "sadness": "sad cry tears grief sorrow mourn depressed lonely heartbreak hurt",
    "surprise": "surprise shocked astonished unexpected sudden gasp wow incredible",
    "anticipation": "wait expect hope eager plan prepare about soon coming",
    "disgust": "disgust disgusting nauseating revolting filth gross vile loathe",
    "trust": "trust believe faith honest reliable safe secure loyal promise",
}
POSITIVE, NEGATIVE = ("joy", "trust", "anticipation"), ("anger", "fear", "sadness", "disgust")

SPEECH_ACTS = {
    "question": r"\?",
    "command": "stop|go|come|leave|get|stay|listen|look|wait|shut|give|take",
    "apology": "sorry|apologize|forgive|pardon|excuse me",
    "promise": "promise|swear|guarantee|will|i'll",
    "threat": "or else|you'll regret|watch out|i'll make you|you don't want",
    "assertion": "is|are|was|were|has|have|had|know|think|believe|feel",
    "exclamation": "!",
}
FORMAL_POLITENESS = "please|would you|could you|if you don't mind|pardon|excuse me|sir|ma'am|mister|miss"
INFORMAL_POLITENESS = "hey|yeah|yep|nah|wanna|gonna|kinda|sorta|dude|man|bro|pal"

# Aspect classes; the first class that holds a verb counts.
ASPECTS = {
    "state": """know believe think understand suppose assume imagine realise realize recognize recognise remember forget notice see
hear love hate like dislike prefer want need wish desire fear enjoy mind regret resent trust doubt be have own contain belong consist
involve concern depend lack deserve tend matter mean resemble seem appear look cost weigh measure fit suit feel smell taste sound""",
    "achievement": """arrive leave depart reach find lose win fail succeed discover realize recognise decide die fall drop hit catch
miss finish stop start begin end enter exit land wake freeze melt shatter snap burst explode crash collide stumble trip slip notice
spot glimpse""",
    "accomplishment": """write build make draw paint create cook prepare solve complete read eat drink clean fix repair learn compose
translate finish describe explain construct produce develop design knit sew carve sculpt bake brew draft compile assemble manufacture
restore heal recover grow raise""",
    "activity": """run walk swim talk speak laugh cry work play study travel sleep sit stand wait watch listen think look search
dance sing drive fly sail wander roam stroll practice exercise train chat gossip drift breathe bleed sweat shake tremble smile
frown""",
}
IRREGULAR_PAST = dict(
    x.split(":")
    for x in """was:be were:be had:have went:go came:come said:say told:tell saw:see knew:know thought:think felt:feel got:get gave:give
took:take made:make left:leave ran:run stood:stand sat:sit fell:fall found:find lost:lose won:win heard:hear held:hold kept:keep
led:lead met:meet read:read sent:send set:set spent:spend wore:wear woke:wake wrote:write built:build caught:catch chose:choose
drew:draw drove:drive drank:drink ate:eat flew:fly froze:freeze grew:grow hung:hang lay:lie meant:mean paid:pay rose:rise rang:ring
sang:sing shook:shake shone:shine shot:shoot showed:show slid:slide slept:sleep spoke:speak swam:swim swore:swear threw:throw
understood:understand wept:weep""".split()
)
STRONG_PAST = tuple("was were had went came said told saw knew thought felt got gave took made left ran stood sat fell".split())

# Signals of free indirect discourse: name, weight, pattern over the text outside quotations.
FID_SIGNALS = (
    ("unquoted_question", 3, r"\?"),
    ("exclamative_how_what", 3, r"(?i)\b(?:How|What(?: a| an)?)\s+\w"),
    ("why_how_question", 2, r"(?im)^(?:Why|How)\s+\w"),
    ("would_future_in_past", 2, r"(?i)\b(?:would|could|might|should)\s+[a-z]+\b"),
    ("temporal_deictic", 2, r"(?i)\b(?:now|today|tomorrow|yesterday|here|this morning|tonight|next week|that day|the next day|the following day)\b"),
    ("evaluative_intensifier", 1, r"(?i)\b(?:so|such|really|absolutely|utterly|simply|just|quite|perfectly|terribly|awfully|horribly|wonderfully|ridiculously)\s+\w"),
    ("second_person_in_narration", 1, r"(?i)\byou\s+(?:could|would|can|will|must|should|have|had|were|are|know)\b"),
)
DOMINANT = tuple("""force command order demand insist require control power authority refuse dismiss decide assert declare announce
impose enforce compel dominate lead direct rule govern own possess master conquer defeat win override reject forbid prevent stop ban
prohibit dictate""".split())
DEFERENT = tuple("""please maybe perhaps possibly wonder suppose might hesitate apologize sorry excuse pardon beg request ask hope wish
afraid nervous uncertain unsure confused lost helpless surrender yield comply obey submit defer barely hardly scarcely somehow rather
somewhat""".split())
IMPERATIVES = r"(?im)^(?:Stop|Go|Come|Leave|Get|Stay|Listen|Look|Wait|Give|Take|Do|Don't|Tell|Show|Help|Follow|Move|Run|Sit|Stand|Open|Close|Read|Write)\b"
HEDGES = r"(?i)\b(?:I think|I suppose|I wonder|I guess|I hope|if you don't mind|would you mind|could you possibly|I'm not sure|I don't know|kind of|sort of|a little|a bit|somewhat|rather)\b"

DOMAINS = {
    "sports": """game team player score goal field court arena coach season penalty referee league tournament championship match
hockey basketball football soccer baseball tennis swimming puck stick skate shot pass defence offense goalie rink""",
    "romance": """love kiss heart relationship boyfriend girlfriend date attraction romance feelings embrace touch desire longing
wedding marriage breakup jealous jealousy flirt intimate""",
    "thriller": "murder kill weapon detective suspect crime police escape chase threat danger secret conspiracy betrayal blackmail",
    "fantasy": "magic wizard dragon kingdom spell quest enchant potion sword castle elf dwarf orc prophecy ancient realm guild",
    "scifi": "spaceship robot android alien planet galaxy laser quantum cybernetic nanite hyperspace singularity terraforming",
}
DOMAIN_FRENCH = {
    "hockey": "hockey", "playoffs": "playoffs", "goal": "but", "penalty": "pénalité", "coach": "entraîneur", "season": "saison",
    "game": "match", "team": "équipe", "love": "amour", "kiss": "baiser", "heart": "coeur",
}
MALE, FEMALE = ("he", "him", "his", "himself"), ("she", "her", "hers", "herself")
INTIMATE = "kiss(?:ed|ing)?|hug(?:ged|ging)?|held|touch(?:ed|ing)?|lov(?:ed|ing)|together|boyfriend|girlfriend|partner|wife|husband|intimat|romanc|affair|heart"
FIRST_PERSON = "i said|i thought|i felt|i was|i walked|i looked"
THIRD_PERSON = "he said|she said|they said|he thought|she thought"
PAST_TENSE = "said was were had felt walked looked smiled laughed ran knew thought came went".split()
PRESENT_TENSE = "says is are has feels walks looks smiles laughs runs knows thinks comes goes".split()
PLACE_PREPOSITIONS = "in|at|to|from|near|outside|inside|through|across"

INFORMAL_WORDS = tuple("cheri merde putain monpote salut tenas tagueule ya cestcool jemesuis onsf".split())
FORMAL_WORDS = tuple("cheri sivousplait veuillez monsieur madame".split())

SEVERE = ("wrong_register_vous", "unexpected_vous", "missing_inline_markers", "prompt_leak")
MAJOR = ("negation_risk", "dialogue_punctuation_lost", "tense_present_drift")
MEDIUM = ("english_heavy", "length_ratio", "profanity_softened", "question_punctuation_lost")
HARD_FLAGS = (
    "empty", "prompt_leak", "english_heavy", "length_ratio", "missing_inline_markers", "wrong_register_vous", "unexpected_vous",
    "negation_risk", "profanity_softened", "dialogue_punctuation_lost", "question_punctuation_lost", "tense_present_drift",
)
HARD_PREFIXES = ("missing_name_", "address_name_lost_", "scene_name_lost_", "glossary_missing_", "glossary_forbidden_")
PENALTIES = {"severe": 45, "major": 30, "medium": 25, "other": 12}

BATCH_TOKENS, BATCH_SIZE, LONG_WORDS = 1400, 4, 350
SHORT_CHARS, SHORT_WORDS, GROUP = 60, 12, 4
QE_THRESHOLD, HEURISTIC_THRESHOLD, SKIP_THRESHOLD, MARGIN = 0.78, 94.0, 96.0, 8.0
MEMORY_THRESHOLD, MEMORY_EXAMPLES, MEMORY_ENTRIES, MEMORY_DRAFT = 0.56, 3, 5000, 0.85
BACK_OVERLAP = 0.46  # least Jaccard of a source and its text rendered back

# The French tenses that suit each class of verbs.
TENSE_ADVICE = {
    "state": "imparfait (states are backgrounded in French past narrative)",
    "activity": "imparfait if ongoing, passe compose if completed",
    "achievement": "passe compose / passe simple (punctual change of state)",
    "accomplishment": "passe compose when the endpoint is reached",
}

# What a translator is told of a book; {} is filled in.
HINTS = {
    "emotions": "Dominant emotional register: {}. Preserve emotional intensity in French.",
    "formal": "Text uses formal register; prefer 'vous' in ambiguous dialogue.",
    "informal": "Text uses informal register; prefer 'tu' in ambiguous dialogue.",
    "act": "Frequent speech act: {}. Preserve illocutionary force in French.",
    "fid": "Free Indirect Discourse detected in ~{}% of sampled chunks. Preserve character's deictic centre and evaluative stance.",
    "aspect": "Dominant Aktionsart: {}. Prefer ",
    "any tense": "context-appropriate tense",
}

# Warnings over parsed tokens; {} is filled in.
TENSE_MIXING = ("tense_mixing: passé simple (", ") and passé composé (", ") in same paragraph")
