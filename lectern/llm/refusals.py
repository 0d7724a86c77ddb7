"""Refusal grammars: how a machine declines its task.

A refusal is a sentence outside quotations of one of these forms, in each language over its own phrases:

    speaker + denial + ... + task         I | cannot | ... | translate this passage (or the other way round)
    task + ... + barred                   this content | ... | is not permitted
    rules + ... + forbids                 my guidelines | ... | do not allow
    apology + ... + speaker + denial      sorry, but | I | can't

The speaker is the machine itself, in the first person or named; a third person who refuses, or who speaks in
quotation marks, is a character of the story. So neither "Il refusa de lire le texte" nor "« Je ne peux pas traduire », dit
Jean" is one. Gaps are within a sentence and bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _parser

QUOTED = re.compile(r"«[^»]*(?:»|$)|“[^”]*(?:”|$)|„[^“”]*(?:[“”]|$)|\"[^\"]*(?:\"|$)")


@dataclass(frozen=True)
class Grammar:
    """Patterns of one language over lower-cased text with straight apostrophes; denial includes the speaker."""

    denial: str
    task: str
    barred: str
    rules: str
    forbids: str
    apology: str


# The phrases of each form, by language.
GRAMMARS = {
    "fr": Grammar(
        denial=r"je ne (?:peux|puis|saurais|dois|veux|souhaite|suis|serai|pourrai|\w+rai|\w+rais) (?:\w+ )?(?:pas|point|guère|malheureusement)|je ne (?:peux|puis|saurais|dois)|je n'(?:ai pas (?:le droit|la possibilité|été)|arrive pas|accepte pas|irai pas)"
        r"|je (?:préfère|préférerais|choisis de|tiens à) ne pas|je (?:me vois|suis) (?:contrainte?|obligée?|au regret) de|je suis incapable|je dois (?:l[ae] |les |vous )?(?:refuser|décliner)|ne peu(?:t|vent) (?:pas |donc )?être|je (?:refuse|décline|m'abstiens|m'abstiendrai)|je dois (?:m'abstenir|m'arrêter)|nous ne (?:pouvons|saurions|devons) pas"
        r"|il (?:m'est|nous est) (?:impossible|interdit|défendu)|il ne m'est pas (?:possible|permis)|dépass\w+ ce que je (?:peux|puis|suis)|(?:ce|cet|le|un) (?:modèle|assistant|système|outil) ne (?:peut|saurait|doit) pas|(?:modèle|assistant|système) refuse",
        task=r"tradu\w+|rend(?:re|rai)\b|reprodui\w+|produi\w+|transcri\w+|poursui\w+|continu\w+|trait(?:er|erai)\b|fourni\w+|répond\w+|accéder|aider|donner (?:suite|une)|(?:ce|cet|cette|ces|le|la|un|du|votre) (?:\w+ )?(?:textes?|extraits?|passages?|contenus?|demandes?|requêtes?|scènes?|lignes?|phrases?)\b|(?:^|^\W+)(?:texte|extrait|passage|contenu|demande|requête)\b",
        barred=r"n(?:e |')(?:est|sont|sera|peut|peuvent|saurait)(?: donc)? (?:pas|malheureusement pas) (?:être|autorisée?s?|permise?s?|possible|disponible|conforme|accept\w+|trait\w+)|(?:est|sont|a été|reste) (?:bloquée?s?|refusée?s?|indisponibles?|interdite?s?|filtrée?s?|rejetée?s?)|\b(?:bloquée?|refusée?|indisponible|interdite?|rejetée?) ?(?:par (?:le (?:filtre|système|modèle)|la (?:politique|modération)|nos|mes|notre)|pour (?:des )?raisons?|en raison|:|$)|indisponible|impossible"
        r"|enfrei(?:n|gn)\w*|va à l'encontre|contrevien\w+|sort du cadre|viole\b|dépasse (?:mes|les|ce que)|contient des éléments que je",
        rules=r"(?:mes|nos|les|ma|notre|ces) (?:consignes|règles|directives|instructions|principes|politiques?|conditions|filtres?|garde-fous|lignes directrices)\b[^.!?]{0,40}",
        forbids=r"(?:m'|nous |l')?interdi\w+|n(?:e |')(?:me |nous |l')?(?:permet|permettent|autorise|autorisent) pas|(?:m'|nous )?empêch\w+|s'y oppos\w+|exclu\w+",
        apology=r"désolée?|navrée?|malheureusement|(?:toutes )?mes excuses|excuses?|je regrette|pardon|en tant qu'(?:assistant|ia|intelligence|modèle)|hélas",
    ),
    "en": Grammar(
        denial=r"\b(?:i|we)(?: (?:just|really|simply|regretfully|also|must|have to|am going to))* (?:cannot|can't|can not|could not|couldn't|won't|will not|must not|mustn't|may not|should not|do not|don't|am unable|am not|are not|are unable|was unable|decline|refuse|(?:would|had) (?:rather|prefer)|prefer not|am afraid i can't)\b"
        r"|\b(?:i'm|i am|we're)(?: \w+)? (?:unable|not able|not allowed|not permitted|not comfortable|not going to|afraid i can(?:'t|not)|declining)|\bi'd (?:rather|prefer) not|(?:this|the) (?:model|assistant|system|tool) (?:cannot|can't|will not|won't|must not|refuses|declines)|not something (?:i|we) (?:can|could|am)",
        task=r"translat\w+|render\w*|produc\w+|reproduc\w+|continu\w+|process\w*|provid\w+|generat\w+|assist\w*|help\w*|fulfil\w*|comply|(?:this|that|these|those|the|your) (?:\w+ )?(?:texts?|passages?|excerpts?|contents?|requests?|lines?|scenes?|sentences?)\b|(?:^|^\W+)(?:text|content|request|passage)\b",
        barred=r"(?:is|are|was|were|been|remains?) (?:not (?:allowed|permitted|possible|available|something)|blocked|refused|unavailable|prohibited|forbidden|declined|filtered|rejected|unsafe)|(?:cannot|can't|must not|may not|won't) be (?:\w+)|violat\w+|against (?:my|our|the) |falls outside|goes beyond|\b(?:blocked|refused|unavailable|rejected|declined)(?: (?:by (?:the (?:filter|system|model|policy)|our|my)|due|because)|:|$)",
        rules=r"(?:my|our|the|these) (?:\w+ )?(?:guidelines?|polic(?:y|ies)|instructions?|rules?|principles|filters?|programming|safeguards)\b[^.!?]{0,30}",
        forbids=r"(?:do|does) not (?:allow|permit|let)|don't (?:allow|permit|let)|doesn't (?:allow|permit|let)|prevent\w*|prohibit\w*|forbid\w*|bars?\b|keeps? me from|won't let",
        apology=r"sorry|apolog\w+|unfortunately|regret\w*|i'm afraid|thank you for your request|as an? (?:ai|assistant|language model|artificial|translation)\b",
    ),
    "de": Grammar(
        denial=r"\b(?:ich|wir) (?:kann|können|darf|dürfen|werde|werden|möchte|soll|will)(?: \w+){0,8} nicht|(?:kann|darf|werde|möchte) ich(?: \w+){0,8} nicht|ich (?:bin|fühle mich) nicht (?:in der lage|befugt|berechtigt)|bin ich nicht in der lage|ich (?:lehne|muss)(?: \w+){0,8} ab(?:lehnen)?\b|ich verweigere|es ist mir (?:nicht|leider)|mir (?:ist es )?nicht (?:möglich|erlaubt|gestattet)",
        task=r"übersetz\w+|wiedergeb\w+|bearbeit\w+|fortsetz\w+|fortfahr\w+|helfen|beantwort\w+|\b(?:diese[nrsm]?|der|den|die|ihre[nr]?|einen) (?:\w+ )?(?:text\w*|auszug\w*|passage\w*|abschnitt\w*|inhalt\w*|anfrage\w*|szene\w*)",
        barred=r"(?:ist|sind|wurde|wird|kann|darf) (?:\w+ ){0,3}(?:nicht (?:möglich|erlaubt|gestattet|verfügbar|übersetzt|zulässig|werden)|blockiert|abgelehnt|gesperrt|unzulässig)|verst(?:ö|o)(?:ß|ss)\w* gegen|blockiert|nicht verfügbar|übersetzt werden|ablehnen|abgelehnt",
        rules=r"(?:meine|unsere|die) (?:\w+ )?(?:richtlinien|anweisung\w*|regeln|vorgaben)[^.!?]{0,30}",
        forbids=r"erlaub\w+ (?:\w+ ){0,4}nicht|verbiet\w+|untersag\w+|(?:lassen|gestatten) (?:\w+ ){0,4}nicht",
        apology=r"leider|tut mir leid|entschuldig\w+|bedau\w+|als (?:ki|sprachmodell|assistent)",
    ),
    "es": Grammar(
        denial=r"no (?:puedo|podemos|debo|quiero|me es posible|me está permitido|estoy (?:autorizad[oa]|en condiciones)|voy a|soy capaz)|(?:me niego|debo (?:negarme|rechazar|declinar)|prefiero no|rechazo|declino)|me (?:es|resulta) imposible|no (?:\w+)ré\b",
        task=r"traduc\w+|traduz\w+|reproduc\w+|continu\w+|procesar|ayudar\w*|responder|atender|(?:este|esta|estos|el|la|su) (?:\w+ )?(?:texto|pasaje|fragmento|contenido|solicitud|escena|líneas?)",
        barred=r"no (?:está|es|puede|se puede)(?: \w+)? (?:permitid[oa]|posible|disponible|autorizad[oa]|ser|traduc\w+)|(?:está|ha sido|fue) (?:bloquead[oa]|rechazad[oa])|bloquead[oa]|infring\w+|viola\b|va en contra",
        rules=r"(?:mis|las|nuestras|mi|la) (?:\w+ )?(?:normas|directrices|instrucciones|políticas?|reglas)[^.!?]{0,30}",
        forbids=r"no (?:me |nos )?permit\w+|(?:me |nos )?prohíb\w+|(?:me |nos )?impid\w+",
        apology=r"lo siento|lamento|disculp\w+|perdón|desafortunadamente|lamentablemente|como (?:ia|asistente|modelo)",
    ),
    "it": Grammar(
        denial=r"non (?:posso|possiamo|devo|voglio|mi è (?:possibile|permesso|consentito)|sono (?:autorizzat[oa]|in grado)|intendo|riesco a)|(?:mi rifiuto|devo (?:rifiutar\w*|declinare)|preferisco non|preferirei non|rifiuto|declino)|mi è impossibile|non (?:\w+)rò\b",
        task=r"tradu\w+|riprodurre|continuare|elaborare|aiutar\w*|rispondere|(?:questo|questa|queste|il|la|tale) (?:\w+ )?(?:testo|brano|passo|contenuto|richiesta|scena|righe)",
        barred=r"non (?:è|può|possono)(?: \w+)? (?:consentit[oa]|possibile|disponibile|autorizzat[oa]|essere|permess[oa]|tradott[oa])|(?:è|è stat[oa]) (?:bloccat[oa]|rifiutat[oa])|bloccat[oa]|viola\b|contrari[oa] a",
        rules=r"(?:le mie|le nostre|la mia|le) (?:\w+ )?(?:linee guida|istruzioni|regole|politiche|norme)[^.!?]{0,30}",
        forbids=r"non (?:mi |ci )?(?:permett\w+|consent\w+)|(?:mi |ci )?(?:vieta\w*|impedis\w+|proibis\w+)",
        apology=r"mi dispiace|spiacente|purtroppo|scus\w+|in quanto (?:ia|assistente|modello)",
    ),
    "pt": Grammar(
        denial=r"não (?:posso|podemos|devo|me é possível|estou autorizad[oa]|consigo|vou|quero)|(?:recuso|prefiro não|devo recusar)|é-me impossível",
        task=r"traduz\w+|tradu(?:ção|ções)|reproduz\w+|continuar|processar|ajudar|responder|(?:este|esta|o|a) (?:\w+ )?(?:texto|trecho|passagem|conteúdo|pedido|cena)",
        barred=r"não (?:é|está|pode)(?: \w+)? (?:permitid[oa]|possível|disponível|ser)|bloquead[oa]|viola\b",
        rules=r"(?:minhas|as|nossas) (?:\w+ )?(?:diretrizes|instruções|regras|políticas|normas)[^.!?]{0,30}",
        forbids=r"não (?:me )?permit\w+|(?:me )?proíb\w+|(?:me )?imped\w+",
        apology=r"desculp\w+|lamento|infelizmente|sinto muito|como (?:ia|assistente|modelo)",
    ),
    "nl": Grammar(
        denial=r"\b(?:ik|we|wij) (?:kan|kunnen|mag|mogen|wil|zal|ga)(?: \w+){0,6} niet|(?:kan|mag) ik(?: \w+){0,6} niet|ik ben niet (?:in staat|bevoegd)|ik weiger|ik moet(?: \w+){0,5} weigeren",
        task=r"vertal\w+|weergeven|verwerken|voortzetten|helpen|beantwoorden|(?:deze|dit|de|het|uw) (?:\w+ )?(?:tekst|passage|fragment|inhoud|verzoek|scène)",
        barred=r"(?:is|zijn|werd|wordt|mag|kan) (?:niet (?:toegestaan|mogelijk|beschikbaar|worden)|geblokkeerd|geweigerd)|in strijd met",
        rules=r"(?:mijn|onze|de) (?:\w+ )?(?:richtlijnen|instructies|regels|beleid)[^.!?]{0,30}",
        forbids=r"(?:staan|staat|laten|laat)(?: \w+){0,4} niet|verbied\w+|verhinder\w+",
        apology=r"helaas|sorry|spijt|excuses|als (?:ai|assistent|taalmodel)",
    ),
}

_SENTENCE = re.compile(r"[^.!?…\n]+")


def _forms(g: Grammar) -> re.Pattern[str]:
    denial, task, barred, apology = (f"(?:{x})" for x in (g.denial, g.task, g.barred, g.apology))
    gap = "[^.!?…\n]{0,90}?"
    return re.compile(f"{denial}{gap}{task}|{task}{gap}(?:{barred}|{denial})|(?:{g.rules})(?:{g.forbids})|{apology}{gap}(?:{denial}|{barred})")


def _needed(parsed: Iterable) -> frozenset[str]:
    """Strings of which every match of a parsed pattern holds one; without any where none is known."""
    found, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        found, run = [*found, frozenset((run,) if run else ())], ""
        if op is _parser.SUBPATTERN:
            found.append(_needed(value[-1]))
        elif op is _parser.BRANCH:
            each = [_needed(x) for x in value[1]]
            found.append(frozenset().union(*each) if all(each) else frozenset())
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0]:
            found.append(_needed(value[2]))
    # the rarest are long and few
    return max((x for x in found if x), key=lambda x: (min(map(len, x)) - len(x) / 50), default=frozenset())


def _shortest(strings: frozenset[str]) -> tuple[str, ...]:
    """Without those that hold another of them."""
    return tuple(sorted(x for x in strings if not any(y != x and y in x for y in strings)))


_FORMS = [_forms(g) for g in GRAMMARS.values()]
_NEEDED = [_shortest(_needed(_parser.parse(p.pattern))) for p in _FORMS]


def declines(text: str) -> bool:
    """The text, outside quotations, declines the task itself. A grammar is tried only where a string is that its forms need."""
    t = QUOTED.sub(" ", text).lower().replace("’", "'")
    for p, needed in zip(_FORMS, _NEEDED):
        for x in needed:
            if x in t:
                if any(p.search(s.group()) for s in _SENTENCE.finditer(t)):
                    return True
                break
    return False
