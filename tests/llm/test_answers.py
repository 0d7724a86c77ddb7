"""Defects of answers: the parts, and the whole on made-up pairs."""

import random

import pytest

from lectern.llm import answers as A
from lectern.llm import language as G
from lectern.llm import refusals as R


@pytest.mark.parametrize(
    "text,open_",
    [("« Oui »", ()), ("« Oui", ("«",)), ("(a [b) c", ()), ("```\nx", ("```",)), ("```x```", ()), ("[[ZXB1X]]a", ("zx1",)), ("[[ZXB1X]]a[[/ZXB1X]]", ()),
     ("<p>a<br>", ("<p>",)), ("<b>a</b>", ()), ("a ) b", ()), ("- un\n- ", ("list",)), ("“a “b” c", ("“",)), ("", ())],
)
def test_pushdown(text, open_):
    assert A.left_open(text) == open_


def test_tiling():
    a, b = "the cat sat on the mat".split(), "on the mat the cat sat".split()
    assert A.tiled(a, b) == 6
    assert A.tiled(a, "le chat".split()) == 0
    assert A.tiled([], b) == 0


@pytest.mark.parametrize(
    "text",
    ["Je ne peux pas traduire ce passage.", "Sorry, I cannot translate this passage.", "Contenu bloqué par le filtre de sécurité.", "Leider kann ich diesen Text nicht übersetzen.",
     "Désolé, cette scène dépasse ce que je suis autorisé à produire.", "I'd rather not render these lines.", "Ik kan dit niet vertalen.", "Não posso traduzir este trecho.", "No puedo traducir este texto.", "Non posso tradurre questo brano.",
     "Ce passage enfreint nos règles d'utilisation.", "Our content policy does not permit it.", "Je me vois contraint de décliner cette demande.", "The requested content is not permitted here.", "Ich muss diese Anfrage leider ablehnen.",
     "Je comprends votre demande, mais je dois la refuser.", "Hélas, je ne saurais poursuivre.", "We are not able to process the text you sent."],
)
def test_refusals(text):
    assert R.declines(text)


@pytest.mark.parametrize(
    "text",
    ["« Je ne peux pas traduire ce texte », dit Jean.", "Il refusa de partir.", "Oui.", "", "Il refusa de lire le texte du contrat et sortit.", "Elle ne voulait pas continuer.", "He could not read the text.",
     "Le passage était bloqué par la neige.", "« Je ne peux pas traduire ce texte", "La porte est fermée depuis hier.", "She declined the invitation and left."],
)
def test_characters_may_decline(text):
    assert not R.declines(text)


NOUNS = {"cat": "chat", "dog": "chien", "boat": "bateau", "hat": "chapeau", "door": "portail", "lamp": "falot", "bench": "banc", "bell": "grelot"}
PLACES = {"garden": "jardin", "kitchen": "cuisine", "attic": "grenier", "forest": "bois", "street": "rue", "harbour": "port"}
VERBS = {"saw": "vit", "sold": "vendit", "lost": "perdit", "found": "trouva"}


def _pair(rng):
    n, m, p, v = rng.choice(list(NOUNS)), rng.choice(list(NOUNS)), rng.choice(list(PLACES)), rng.choice(list(VERBS))
    who = rng.choice(["Zora", "Milo", "Tavek", "Bruna", "Olgu"])
    return f"{who} {v} the {n} and the {m} near the {p}.", f"{who} {VERBS[v]} le {NOUNS[n]} et le {NOUNS[m]} près du {PLACES[p]}."


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(2)
    rows = []
    for k in range(900):
        s, t = _pair(rng)
        rows.append([k, s, t, t, "m", "p"])
    faults = {
        0: ("draft", "", "empty"), 1: ("final", "« »", "empty"), 2: ("draft", rows[2][1], "copy"), 3: ("final", "Traduction : " + rows[3][1].upper(), "copy"),
        4: ("draft", "The night was long and they were not in the house.", "language"), 5: ("final", "Je ne peux pas traduire ce passage.", "refusal"),
        6: ("draft", rows[6][2][:-14], "truncated"), 7: ("final", rows[7][2][: len(rows[7][2]) // 2], "truncated"),
    }
    for k, (f, text, _) in faults.items():
        rows[k][2 if f == "draft" else 3] = text
    rows[8][3] = rows[8][2][:-1]  # lacks nothing but its full stop
    rows += [[900, "1760.", "1760.", "1760.", "m", "p"], [901, "* * *", "* * *", "", None, None], [902, None, None, None, "m", "p"], [903, None, "Le chat dort.", None, "m", "p"], [904, "", "", "", "m", "p"]]
    df = spark.createDataFrame([tuple(r) for r in rows], "chunk_id bigint, source string, draft string, final string, model string, patcher string")
    return df, {(k, f): d for k, (f, _, d) in faults.items()}


FRENCH = """Le chat dort dans la maison. Il avait plu toute la nuit et la rue était encore mouillée. Elle ouvrit la porte sans faire de bruit. Nous étions
partis avant le lever du jour. Les enfants jouaient près de la rivière. Son frère ne répondit pas tout de suite. Je ne sais pas où il est allé. Une lumière brillait
derrière les rideaux. Ils marchèrent longtemps sans parler. Le vieux médecin posa son chapeau sur la table. On entendait au loin le bruit de la mer. Cette histoire
commence dans un petit village de montagne. Vous avez raison, dit la femme en souriant. Personne ne voulait croire ce qu'elle racontait. Quand le train arriva, la gare
était vide. Mon père travaillait au moulin depuis sa jeunesse. Tout le monde connaissait la maison du pont. La pluie tombait doucement sur les toits. Il n'y avait plus
rien à manger ni à boire. Elle regarda longuement la lettre avant de la brûler."""
ENGLISH = """The cat sleeps in the house. It had rained all night and the street was still wet. She opened the door without making a noise. We had left before
daybreak. The children were playing near the river. Her brother did not answer at once. I do not know where he went. A light shone behind the curtains. They walked for
a long time without talking. The old doctor put his hat on the table. The noise of the sea could be heard far away. This story begins in a small mountain village. You
are right, said the woman with a smile. Nobody wanted to believe what she told. When the train arrived the station was empty. My father had worked at the mill since his
youth. Everybody knew the house by the bridge. The rain fell softly on the roofs. There was nothing left to eat or drink. She looked at the letter for a long time."""


@pytest.fixture(scope="module")
def french():
    split = lambda t: [A.WORD.findall(x.lower()) for x in t.split(".") if x.strip()]
    m = A.Model(language=G.fit(split(FRENCH), split(ENGLISH)))
    m.seen = frozenset(A.WORD.findall(FRENCH.lower()))
    return m


@pytest.mark.parametrize(
    "text,other",
    [("De oude man liep langzaam door het stille dorp en keek niet om.", True), ("Stary człowiek szedł powoli przez cichą wieś i nie oglądał się.", True),
     ("Bătrânul mergea încet prin satul liniștit și nu privea înapoi.", True), ("O velho caminhava devagar pela aldeia silenciosa e não olhava para trás.", True),
     ("Den gamle mannen gick långsamt genom den tysta byn och såg sig inte om.", True), ("Old wooden boats drift slowly past quiet green hills.", True),
     ("Es war kalt und niemand wollte das Zimmer verlassen.", True), ("Il vecchio camminava piano per il villaggio silenzioso senza voltarsi.", True), ("El viejo pescador caminaba despacio por el pueblo silencioso.", True),
     ("Ветер унёс последнее письмо", True), ("La femme posa la lettre sur la table et ne répondit pas.", False), ("« Wie schön ist das Leben », dit-il en posant son chapeau sur la table.", False),
     ("Le vieil homme ouvrit la porte de la maison sans parler.", False), ("1760.", False), ("Oui.", False), ("Zora Milo.", False)],
)
def test_language(french, text, other):
    assert A.foreign(A.side_of("“Wie schön ist das Leben,” he said.", french), text, french) == other


def test_defects(chunks):
    df, want = chunks
    m = A.fit(df)
    got = {(r.chunk_id, r.field): r.defect for r in A.defects(df.selectExpr("*", "'x' as defect"), m).collect()}
    assert got == want
    scores = A.cut_scores(df, m)
    assert scores.count() == 904 + 903 and scores.columns == ["chunk_id", "field", "cut_log_odds"]
    assert {(r.chunk_id, r.field) for r in A.cut_texts(df, m).collect()} == {k for k, d in want.items() if d == "truncated"}
    report = {(r.field, r.producer): (r.n_texts, r.n_cut) for r in A.truncation_report(df, m).collect()}
    assert report["draft", "m"] == (903, 1) and report["final", "p"] == (902, 1)


def test_what_is_left_open_is_truncated(chunks):
    """Whatever the score: the parser decides where a text ends inside a quotation, bracket or markup without a closing sign."""
    m = A.fit(chunks[0])
    m.threshold = 1e9
    s = A.side_of("“Zora saw the cat (and the dog) near the garden,” said Milo.", m)
    for text, want in (("« Zora vit le chat (et le chien", "truncated"), ("« Zora vit le chat (et le chien) près du jardin », dit Milo.", None), ("« Zora vit le chat [[ZXB1X]]et le", "truncated"), ("Zora vit le chat et le", None)):
        assert A.defect(s, text, "m", m) == want


def test_threshold_separates_held_out_scores():
    assert -1 < A._threshold([(x / 10, 0) for x in range(-60, -20)] + [(x / 10, 1) for x in range(20, 60)]) < 1
    assert A._threshold([]) == 0.0


def test_held_out_cuts(spark):
    rng = random.Random(5)
    train = spark.createDataFrame([(k, *(p := _pair(rng)), p[1], "m", "p") for k in range(800)], "chunk_id bigint, source string, draft string, final string, model string, patcher string")
    m = A.fit(train)
    wrong = 0
    for _ in range(300):
        s, t = _pair(rng)
        side = A.side_of(s, m)
        cut = t[: rng.randint(8, len(t) - 8)]
        wrong += A.defect(side, t, "m", m) is not None
        wrong += A.defect(side, cut, "m", m) != "truncated"
    assert wrong <= 12  # 98 % of 600


def test_empty_table(spark):
    df = spark.createDataFrame([], "chunk_id bigint, source string, draft string, final string, model string, patcher string")
    assert A.defects(df).count() == 0 and A.truncation_report(df).count() == 0


def test_a_grammar_needs_one_of_its_strings():
    needed = lambda p: R._shortest(R._needed(R._parser.parse(p)))
    assert needed("(?:ab|c)d+ef(?:gh)?") == ("ef",) and needed("ab|cd?e*") == ("ab", "c") and needed("a*") == () and needed("x?|y") == ()
    assert all(R._NEEDED)
    rng = random.Random(8)
    signs = ["je ne peux pas ", "traduire ", "désolé", ", ", ". ", "i cannot ", "this text ", "leider ", "ich kann ", "nicht ", "non posso ", "il testo ", "como ia ", "«", "»", "the cat "]
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(1, 8)))
        plain = R.QUOTED.sub(" ", t).lower()
        assert R.declines(t) == any(p.search(x.group()) for x in R._SENTENCE.finditer(plain) for p in R._FORMS), t
