"""Personal information in texts: proposed generously, judged by boosted trees, replaced.

High-recall generators propose overlapping spans for e-mail addresses, phone numbers,
identity numbers, street addresses and names. A small boosted-tree model per type, trained
here on labelled sentences made from templates, judges each span by its format and its
context, with a threshold calibrated on held-out sentences. Of overlapping accepted spans
the surest (then longest) stays, and each is replaced by a placeholder of its type.

The sentences are composed of cues, separators and tails written for this purpose and of
random values; none is taken from a corpus that is scanned. Whether a capitalised word is an
ordinary one is told by a public tokenizer's vocabulary.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.gbdt import Boosted, threshold
from heddle.session import python_input

TYPES = ("email", "phone", "id_number", "address", "person")
#: Labelled sentences the models are fitted on: a fixed number, whatever the data.
TRAINING_SENTENCES = 24_000
#: Precision that a type's threshold has to keep on the sentences held out for calibration.
PRECISION = 0.93
#: Given names are held by every worker: a lexicon of more bytes is refused.
LEXICON_BYTES = 64 << 20
#: Vocabulary that ordinary words are looked up in, read by the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# ---- fixed values: formats, street words, cue words ----
_W = r"A-Za-zÀ-ÖØ-öø-ÿŒœŠšŽž"
_UP = r"A-ZÀ-ÖØ-ÞŒŠŽ"
_AT = r"(?:@|\s?\[\s?at\s?\]\s?|\s?\(\s?at\s?\)\s?|\s(?:AT|at)\s)"
_DOT = r"(?:\.|\s?\[\s?dot\s?\]\s?|\s?\(\s?dot\s?\)\s?|\s(?:DOT|dot)\s)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9](?:[A-Za-z0-9_%+'-]|\.(?=[A-Za-z0-9]))*{_AT}(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?{_DOT})+[A-Za-z]{{2,}}(?![A-Za-z0-9-]*[A-Za-z0-9@])", re.I)
_ANCHOR = re.compile(r"@|[\[(]\s?[Aa][Tt]\s?[\])]|\s[Aa][Tt]\s")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+'.-")
_DIGITS = re.compile(r"\d[\d ()./-]{5,}")
_EXT = r"(?:,?\s?(?:ext\.?|extension|x|Durchwahl|poste)\s?\d{1,6})?"
PHONE = re.compile(
    r"(?<![\w+./:-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(0\)[ ]?)?(?:\(\d{1,4}\)[ ]?)?\d{1,5}(?:[ ./-]?\d{2,7}){1,5}"
    r"|00\d{2,3}(?:[ ./-]?\d{1,7}){2,6}"
    r"|\(\d{2,5}\)[ ]?\d{2,4}(?:[ .-]\d{2,5}){1,3}"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|0\d{2,4}[/ -]\d{3,8}(?:[ -]\d{2,5}){0,3}"
    r"|\d{3}[.-]\d{3}[.-]\d{4}|\d{3} \d{3} \d{4}|[2-9]\d{9}|0\d{9,10}"
    rf"){_EXT}(?![\w@]|[.-]\d)"
)
ID_NUMBER = re.compile(
    r"(?<![\w./:-])(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]"
    r"|\d{3}([- ])\d{2}\1\d{4}"
    r"|\d{2} \d{3} \d{3} \d{3}|[0-9]{11}"
    r"|[A-Z]{1,2}[0-9]{6,8}|[XYZ]?\d{7,8}-?[A-Z]"
    r"|\d{4}-\d{4}-\d{2}|[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|\d{6,9}"
    r")(?![\w@]|[.-]\d)"
)
_STREET = (
    r"(?:Street|Avenue|Road|Lane|Close|Drive|Court|Way|Place|Square|Terrace|Boulevard|Crescent|Gardens|Grove|Mews|Row|Walk|Hill|Parkway"
    r"|(?:St|Ave|Rd|Ln|Dr|Ct|Pl|Sq|Blvd|Pkwy)(?:\.(?=,| \d| [A-Z]{2} \d| (?:Apt|Suite|Unit|Flat)\b))?)(?!\w)"
)
_CAPITAL = rf"[{_UP}](?:[{_W}’'-]*[{_W}])"
_PLACE = rf"{_CAPITAL}(?: (?:am|an der|sur|de|la|le|les|upon|on|St\.?|Saint)(?= [{_UP}])| {_CAPITAL})*?(?=[,.;:)\s!?\"'<>|\]}}]|$)"
_POST = r"(?:[A-Z]{1,3}\d{1,2}[A-Z]? ?\d[A-Z]{2}|[A-Z]{2} \d{5}(?:-\d{4})?|\d{5})(?!\w)"
_ROOM = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room|Floor)\.? \d+[A-Za-z]?)"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:"
    # house number before an English street
    rf"(?:{_ROOM}, )?\d{{1,5}}[A-Za-z]? (?:{_CAPITAL} ){{1,3}}{_STREET}(?:,? {_ROOM})?(?:, {_PLACE})?(?:,? {_POST})?"
    # French
    rf"|\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours) (?:(?:de la|de l’|de l'|des|du|de|d’|d') ?)?{_CAPITAL}(?: {_CAPITAL})*(?:, \d{{5}}(?: {_PLACE})?)?"
    # Spanish
    rf"|(?:Calle|C/|Avenida|Avda\.|Plaza|Paseo|Camino) (?:(?:del|de la|de los|de las|de) )?{_CAPITAL}(?: {_CAPITAL})*,? \d{{1,4}}(?:, \d{{1,2}}\.?[ºª°](?: ?[A-Z]\b)?)?(?:, \d{{5}}(?: {_PLACE})?)?"
    # German
    rf"|(?:[{_UP}][{_W}-]*(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|ufer|damm)|[{_UP}][{_W}-]+(?:er)? (?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring)) \d{{1,4}}(?: ?[a-z]\b)?(?:, \d{{5}}(?: {_PLACE})?)?"
    rf")"
)
#: An address has one of these, and at most so many characters on either side of it.
STREET_MARKS = (
    *(f" {w}" for w in "Street St Avenue Ave Road Rd Lane Ln Close Drive Dr Court Ct Way Place Pl Square Sq Terrace Boulevard Blvd Crescent Gardens Grove Mews Row Walk Hill Parkway Pkwy".split()),
    *(f"{n}{w} " for n in ("{d} ", "{d}, ", " bis ", " bis, ", " ter ", " ter, ", " quater ",
    " quater, ") for w in "rue avenue boulevard place chemin impasse allée quai cours".split()),
    *(f"{w} " for w in "Calle C/ Avenida Avda. Plaza Paseo Camino".split()),
    *(f"{w} {{d}}" for w in "straße strasse str. weg allee platz gasse ring ufer damm Straße Strasse Str. Weg Allee Platz Gasse Ring".split()),
)
STREET_REACH = 300
_SUR = rf"[{_UP}](?:(?:[{_W}]|[’'](?!s\b))*[{_W}])(?:-[{_UP}](?:(?:[{_W}]|[’'](?!s\b))*[{_W}]))?"
_GIVEN = rf"[{_UP}][a-zß-öø-ÿœšž’']+(?:-[{_UP}][a-zß-öø-ÿœšž]+)?"
_NAME_END = rf"(?![{_W}0-9_@]|-[{_W}])"
NAME_FORWARD = re.compile(rf"(?<![{_W}0-9_@./-])(?=((?:{_GIVEN}|[{_UP}]\.)(?:[  ][{_UP}]\.){{0,2}}[  ](?:(?:von|van|de|del|di|da|du) (?:(?:der|den|la|le|las|los) )?)?{_SUR}){_NAME_END})")
NAME_INVERTED = re.compile(rf"(?<![{_W}0-9_@./-])(?=({_SUR}, (?:{_GIVEN}|[{_UP}]\.)(?:[  ][{_UP}]\.(?![{_W}])){{0,2}}){_NAME_END})")
_INVERSION = re.compile(rf", (?=[{_UP}])")
_IN_NAMES = frozenset("’'-_@./")
CUES = {
    "email": (
        "mail email e-mail mails contact write reach address inbox cc bcc from to owner author user sender recipient bounced correo "
        "courriel kontakt escribir rückfragen schreiben adresse"
    ).split(),
    "phone": (
        "tel tel. tél telefon teléfono téléphone phone mobile cell call ring dial fax number nummer numéro número handy móvil portable "
        "on-call hotline landline festnetz anschluss fixe fijo whatsapp sms rufnummer mobil voicemail pager"
    ).split(),
    "id_number": "ssn passport pass id personal insurance tax national steuer-id steuernummer steueridentifikationsnummer nif nie dni nino curp "
    "insee number no no. nr ausweis personalausweis filed social security sécurité sociale "
    "personalausweisnummer ausweisnummer ausweis-nr sozialversicherungsnummer reisepass passnummer dokument seguro identity identidad identité identification license licence permit citizen taxpayer sozialversicherung personal_number personnel nummer número numéro".split(),
    "address": (
        "address adresse anschrift dirección office visit moved ship shipped send sent deliver delivered postal wohnt wohnhaft lives live "
        "living resides badge at in home domicilio domicile residence mailing located"
    ).split(),
    "person": "by by: von par por ask cc thanks to from for signed-off-by signed dr mr mrs ms herr frau señor señora madame monsieur reviewer "
    "reviewed reported assigned owner copyright as contact author wrote dear name named maintainer "
    "gemeldet signalé informado met called with am is I'm manager engineer colleague meet contacto patient customer client employee "
    "bei mit con avec sincerely regards "
    "reviewers approver approvers approved assignee assignees authors owners maintainers contributor contributors speaker speakers "
    "participant participants attendee attendees signer doctor sir mlle señorita uncle aunt mother father brother sister husband wife "
    "friend boss neighbour neighbor "
    "applicant tenant witness student teacher nurse guest host user member hired asked saw seen firmado firmó unterzeichnet unterschrieben signé rédigé geschrieben escrito laut selon según durch through sincères cordialement saludos grüßen heiße m’appelle llamo".split(),
}
AGAINST = (
    "case tracking transaction account parcel sku reference ref revision checksum epoch timestamp pid request session order_id count "
    "total amount phase ticket serial build range port ports trace version rule page advisory release frame depth elapsed run digest "
    "sha256 image commit listing score entries workers install pin uvx order invoice model part batch item row line step code error since "
    "between limit isbn issue"
).split()
AFTER_PERSON = (
    "wrote signed noted called said says via asked reported joined will has had is was and who works replied agreed schrieb sagte hat "
    "écrit dit escribió dijo et und y"
).split()
AFTER_PRODUCT = (
    "service library tool app api sdk client cluster runtime engine framework edition suite studio cloud license foundation university "
    "street avenue connector bridge adapter server gateway release replaces reached plugin package module client ships project team"
).split()
STOP = frozenset(
    "the a an on in at as if of to for from with and or but by is it we our my this that these those when where who what why how "
    "which while between after before both use see set run think let no not "
    "der die das ein eine im am bei für nach le la les un une des el los las una al en se si "
    "monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag lundi mardi mercredi jeudi "
    "vendredi lunes martes "
    "january february march april may june july august september october november december "
    "mail call contact write reach office address adresse anschrift postal suite flat street ave avenue road lane close telefon phone "
    "dr mr mrs ms prof sir dear reviewer "
    "known removed changed deprecated version please reported assigned thanks signed copyright steps expected actual advisory ticket serial listing nothing pin install retries regel wert bitte severity affected runs remove state name rank given assume consider suppose during could".split()
)
PARTICLES = frozenset("von van de del di da du".split())
#: Ends of nouns that are no names, in the languages of the texts.
ABSTRACT_ENDS = ("ung", "ungen", "heit", "keit", "schaft", "tion", "tionen", "ción", "ciones", "dad", "ment", "ments", "miento", "ture",
    "ness", "ance", "ence", "ity", "té", "ware", "ing", "ings", "ismus", "ismo", "isme")
SURNAME_ENDS = ("berg", "dahl", "son", "sen", "ssen", "well", "ford", "shaw", "eau", "mont", "kard", "ard", "lund", "beck", "ski", "ska",
    "ovic", "ovich", "ez", "ura", "vane", "ward", "ton", "man", "mann", "er", "ley", "field", "stein", "quist", "oux", "ier", "etti",
    "ini", "ov", "ova", "escu", "enko")
# ---- end of fixed values ----

_WORD = re.compile(rf"[{_W}0-9-]+")
#: Between sentences or lines; the dot of a short word is that of an abbreviation.
_SENTENCE = re.compile(r"(?:[a-z\d]{3}(?<!rof)[.!?]|[!?])\s+|\n")


def ordinary_words(path: str = VOCABULARY) -> frozenset[str]:
    """Words in small letters that a public tokenizer's vocabulary holds whole, as common ones are."""
    import base64

    with open(path, "rb") as f:
        tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
        texts = (t[1:].decode("utf-8", "ignore") for t in tokens if t[:1] == b" ")
        return frozenset(t for t in texts if len(t) > 2 and t.isalpha() and t.islower())


class Lexicon:
    """Known given names, and how alike to them another word is (the list is incomplete)."""

    def __init__(self, names: list[str], words: frozenset[str] = frozenset()):
        self.names, self.words = frozenset(names), words | STOP | {w.lower() for w in HEADINGS}
        low = [n.lower() for n in names if len(n) >= 2]
        self.heads = {k: frozenset(n[:k] for n in low) for k in (2, 3)}
        self.tails = {k: frozenset(n[-k:] for n in low) for k in (1, 2)}

    def likeness(self, word: str) -> float:
        """3 for a known name, else up to 2.5 by the beginnings and ends of known ones."""
        if word in self.names:
            return 3.0
        w = word.lower()
        return 0.5 * (w[:2] in self.heads[2]) + (w[:3] in self.heads[3]) + 0.25 * (w[-1:] in self.tails[1]) + 0.75 * (w[-2:] in self.tails[2])


def _spans(pattern: re.Pattern, text: str, group: int = 0) -> list[tuple[int, int]]:
    return [m.span(group) for m in pattern.finditer(text)]


_MARKS = None


def _street_zones(text: str) -> list[tuple[int, int]]:
    """Where an address may be: around the marks that every pattern of one contains."""
    global _MARKS
    if _MARKS is None:
        import ahocorasick

        _MARKS = ahocorasick.Automaton()
        for mark in STREET_MARKS:
            for d in "0123456789" if "{d}" in mark else "0":
                _MARKS.add_word(mark.replace("{d}", d), mark.startswith(" ") and mark[-1].isalpha())
        _MARKS.make_automaton()
    zones: list[tuple[int, int]] = []
    for end, whole_word in _MARKS.iter(text):
        if whole_word and text[end + 1 : end + 2].isalnum():
            continue
        a, b = max(0, end - STREET_REACH), end + STREET_REACH
        if zones and a <= zones[-1][1]:
            zones[-1] = (zones[-1][0], b)
        else:
            zones.append((a, b))
    return zones


def propose(text: str) -> list[tuple[str, int, int]]:
    """Overlapping candidates (type, start, end), generous on purpose."""
    out: list[tuple[str, int, int]] = []
    for anchor in _ANCHOR.finditer(text):  # the pattern only where something stands for an at sign
        a = anchor.start() - text[max(0, anchor.start() - 1) : anchor.start()].isspace()
        end = a
        while a and text[a - 1] in _LOCAL:  # however long; parts between signs are read once
            a -= 1
        while a < end and not text[a].isalnum():
            a += 1
        whole = EMAIL.match(text, a) if a < end and not text[a - 1 : a].isalnum() else None
        if whole and whole.end() > anchor.start():
            out.append(("email", *whole.span()))
    numbers = set()
    for zone in _DIGITS.finditer(text):  # numbers only where six digits are close together
        a, b = max(0, zone.start() - 4), min(len(text), zone.end() + 20)
        for kind, pattern in (("phone", PHONE), ("id_number", ID_NUMBER)):
            numbers |= {(kind, *m.span()) for m in pattern.finditer(text, a, b)}
    out += sorted(numbers, key=lambda n: n[1:])
    for a, b in _street_zones(text):
        out += [("address", *m.span()) for m in ADDRESS.finditer(text, a, min(b, len(text)))]
    for a, b in _spans(NAME_FORWARD, text, 1):
        out.append(("person", a, b))
        if text[a:b].count(" ") > 1 and text[a + 1] != ".":  # also without the first word
            rest = re.match(rf"\S+ (?=(?:{_GIVEN}|[{_UP}]\.) )", text[a:b])
            if rest:
                out.append(("person", a + rest.end(), b))
    for comma in _INVERSION.finditer(text):  # the name before a comma starts where its word or a part of it does
        a = comma.start()
        while a and (text[a - 1].isalnum() or text[a - 1] in _IN_NAMES):
            a -= 1
            if not a or text[a - 1] in "’'" or not (text[a - 1].isalnum() or text[a - 1] in _IN_NAMES):
                m = NAME_INVERTED.match(text, a)
                if m and m.end(1) > comma.start():
                    out.append(("person", *m.span(1)))
    return out


def _cue(words: list[str], cues: frozenset) -> float:
    """3, 2, 1 for a cue as the nearest, second or a further word; 0 for none."""
    for k, w in enumerate(reversed(words)):
        if w in cues or w.strip("-_") in cues:
            return (3.0, 2.0, 1.0, 1.0)[min(k, 3)]
    return 0.0


_CUES = {k: frozenset(v) for k, v in CUES.items()}
_AGAINST, _AFTER_PERSON, _AFTER_PRODUCT = frozenset(AGAINST), frozenset(AFTER_PERSON), frozenset(AFTER_PRODUCT)


#: Shapes that features ask for, compiled once.
_DIGIT_RUNS = re.compile(r"\d+")
_VERSION_AFTER = re.compile(r" ?v?\d+\.\d")
_BRACKET = re.compile(r"\[|\(")
_SPELLED_AT = re.compile(r"\s(?:AT|at)\s")
_CAPITAL_AT = re.compile(r" (?:AT|DOT) ")
_GIT_USER = re.compile(r"git@")
_IN_URL = re.compile(r"://\S*$")
_SSN = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}")
_TAX_ID = re.compile(r"\d{2} \d{3} \d{3} \d{3}")
_NINO = re.compile(r"[A-Z]{2}( ?\d{2}){3} ?[A-Z]")
_PASSPORT = re.compile(r"[A-Z]{1,2}\d{6,8}")
_DNI = re.compile(r"[XYZ]?\d{7,8}-?[A-Z]")
_INSEE = re.compile(r"[12]( \d{2}){3}( \d{3}){2}( \d{2})?")
_POSTCODE = re.compile(r"\d{5}|[A-Z]{1,2}\d \d[A-Z]{2}")
_SPANISH = re.compile(r"Calle|C/|Av|Plaza|Paseo|Camino")
_GERMAN = re.compile(r"straße|strasse|str\.|weg|allee|platz|gasse")
_FRENCH = re.compile(r"\b(?:rue|avenue|boulevard|chemin|impasse)\b")
_COMMA_CAPITAL = re.compile(r"[,][  ][A-Z]")
_BLANK_CAPITAL = re.compile(r"[  ][A-Z]")
_WORD_BEFORE = re.compile(r"\s*[-–]?\s*\w")
_NUMBER_AFTER = re.compile(r"[ \t]*\d")
_SENTENCE_START = re.compile(r"[.!?:;|>\"\n]\s*$|^\s*$")
_AT_SIGN, _DOTS = re.compile(_AT, re.I), re.compile(r"\.|dot", re.I)
_STREET_ANY, _STREET_END = re.compile(_STREET), re.compile(_STREET + "$")
_LEAD = re.compile(rf"([{_UP}][{_W}'’-]+)[  ]$")


def features(text: str, kind: str, a: int, b: int, lexicon: Lexicon, inside: bool) -> list[float]:
    """Format and context of one candidate; ``inside`` an e-mail address or package."""
    s = text[a:b]
    left, right = text[max(0, a - 40) : a], text[b : b + 40]
    before = [w.lower() for w in _WORD.findall(_SENTENCE.split(left.rstrip())[-1])][-4:]
    after = [w.lower() for w in _WORD.findall(right)][:4]
    digits = sum(c.isdigit() for c in s)
    prev, nxt = text[a - 1 : a], text[b : b + 1]
    groups = _DIGIT_RUNS.findall(s)
    common = [
        float(len(s)), float(digits), float(len(groups)), digits / max(1, len(s)), float(max(map(len, groups), default=0)),
        _cue(before, _CUES[kind]), _cue(before, _AGAINST), float(inside),
        float(prev in "@/\\=_#$%~" and prev != "" ), float(nxt in "@/\\=_%:" and nxt != ""), float(bool(_VERSION_AFTER.match(right))),
    ]
    if kind == "email":
        domain = _AT_SIGN.split(s, maxsplit=1)[-1]
        return [*common, float("@" in s), float(bool(_BRACKET.search(s))), float(bool(_SPELLED_AT.search(s))),
            float(bool(_CAPITAL_AT.search(s))), float(len(_DOTS.findall(domain))), float(bool(_GIT_USER.match(s))), float(nxt == ":"),
            float(bool(_IN_URL.search(left))), float("dot" in domain.lower())]
    if kind == "phone":
        return [*common, float(s[0] == "+"), float(s.startswith("00")), float(s[0] == "0"), float(s[0] == "("), float("ext" in s),
            float("/" in s), float("." in s), float(s.count("-")), float(s.count(" ")), float(digits >= 10),
            float(prev in '"([| ' or prev == "")]
    if kind == "id_number":
        letters = sum(c.isalpha() for c in s)
        return [*common, float(letters), float(s[:2].isalpha()), float(s[-1].isalpha()), float(bool(_SSN.fullmatch(s))),
            float(bool(_TAX_ID.fullmatch(s))), float(bool(_NINO.fullmatch(s))), float(bool(_DIGIT_RUNS.fullmatch(s))),
            float(bool(_PASSPORT.fullmatch(s))), float(bool(_DNI.fullmatch(s))), float(bool(_INSEE.fullmatch(s))), float(s.count("-")),
            float(s.count(" ")), _cue(after[::-1], _CUES[kind]), _cue(after[::-1], _AGAINST)]
    if kind == "address":
        return [*common, float(bool(_POSTCODE.search(s))), float(s.count(",")), float(bool(_STREET_ANY.search(s))),
            float(bool(_SPANISH.match(s))), float(bool(_GERMAN.search(s))), float(bool(_FRENCH.search(s)))]
    inverted = ", " in s
    parts = s.replace(",", "").split()
    # The word right before, if it could be a name that this span cuts off.
    lead = _LEAD.search(left)
    cut = 0.0 if not lead or lead[1].lower() in STOP else 1.0 + lexicon.likeness(lead[1])
    given, sur = (parts[1], parts[0]) if inverted else (parts[0], parts[-1])
    initial = given.endswith(".")
    tail = sur.split("-")[-1].lower()
    return [
        *common, float(inverted), float(initial), 1.5 if initial else lexicon.likeness(given), lexicon.likeness(sur.capitalize()),
        float(given.lower().strip(".") in STOP and not initial), float(sur.lower() in STOP), float(tail.endswith(SURNAME_ENDS)),
            float(len(sur)), float(len(given)), float(sur.isupper()),
        float(given.isupper() and not initial), float(len(parts)), float("-" in sur), float(bool(after) and after[0] in _AFTER_PERSON),
            float(bool(after) and after[0] in _AFTER_PRODUCT),
        float(parts[0].lower().strip(".") in lexicon.words), float(parts[-1].lower() in lexicon.words),
            float(any(p.lower().endswith(ABSTRACT_ENDS) for p in parts)),
            float(any(p in PARTICLES for p in parts)) * (1.0 + lexicon.likeness(given)), float(bool(_COMMA_CAPITAL.match(right))),
            float(bool(_BLANK_CAPITAL.match(right))), float(bool(_WORD_BEFORE.match(left[-1:]) is None)),
        float(bool(_NUMBER_AFTER.match(right))), float(bool(_SENTENCE_START.search(left))), float(bool(_STREET_END.search(s))),
            float(prev == '"' or nxt == '"'), cut,
    ]


# ---------------------------------------------------------------- labelled sentences


# ---- fixed values: cues, separators and tails that labelled sentences are composed of ----
LEADS = {
    "email": (
        "Send it over to", "You can write me under", "My inbox is", "Drop a line to", "E-Mail-Adresse lautet", "Schreiben Sie bitte an",
        "Mon adresse est", "Merci d’écrire à", "Mi correo es", "Escríbeme a", "from", "reply-to", "mail_to", "recipient", "account holder",
        "sender", "", "forwarded by",
        "the invitation went to", "login", "unsubscribe",
    ),
    "phone": (
        "Ring me on", "My number is", "Mobile no.", "Dial", "Text", "You reach us under", "Rufnummer", "Handy", "Meine Nummer ist",
        "Mon numéro est le", "Portable", "Appelez le", "Mi número es", "Móvil", "Llámame al", "phone_number", "cell", "voicemail at", "",
        "emergency contact", "WhatsApp", "desk phone",
    ),
    "id_number": (
        "My social security number is", "Passport number", "passport", "National insurance number", "tax id", "taxpayer id",
        "identity card no.", "driver’s licence", "Steueridentifikationsnummer", "Personalausweisnummer", "Ausweis-Nr.",
        "Sozialversicherungsnummer", "numéro de sécurité sociale", "carte d’identité no",
        "Mi DNI es", "NIE", "número de la seguridad social", "ssn", "national_id", "citizen id", "personnel number", "she gave",
        "the form lists", "born 1984, id", "identification", "id",
    ),
    "address": (
        "I live at", "Deliver the parcel to", "Our office is located at", "Mailing address", "home", "the house at", "Ich wohne in der",
        "Lieferadresse", "Bitte senden an", "J’habite au", "Livrer à", "Vivo en", "Enviar a", "Domicilio", "street_address", "addr",
        "resides at", "from the shop at", "", "meet us in",
    ),
    "person": (
        "My name is", "I am", "Yesterday I met", "We hired", "Regards,\n", "Please forward this to", "Patient", "Customer", "Approved by",
        "According to", "Our manager", "her colleague", "Ich heiße", "Mit freundlichen Grüßen\n", "Frau", "Herr", "Termin mit",
        "Je m’appelle", "Bonjour", "Madame", "avec", "Me llamo",
        "Erstellt von", "Geprüft von", "Verfasst von", "Gesendet von", "Entdeckt von", "Bestätigt von", "Traducido por", "Traduit par",
        "Betreut von", "Rédigé par", "Vérifié par", "Revisado por", "Dirigido por", "Copyright ©", "Copyright 2021", "© 2020",
        "licence holder", "Drawn by", "My aunt", "our neighbour", "Hallo", "Cher", "Querida", "Hello", "This is", "signed,", "speaker",
        "witness", "authors",
        "Señor", "Señora", "con", "Hi", "full_name", "employee", "author", "contact person", "attendees", "interview with", "drafted by",
        "", "the late", "on behalf of", "email from", "photo:", "Prof.", "Mrs", "Mr", "Ms", "Miss", "Sir", "Dr", "Mme", "Sra.",
    ),
}
JOINS = (" ", " ", " ", ": ", ": ", "=", " = ", " – ", "\t", " | ", '": "', "='", " (", " <", ",", "\n")
TAILS = (
    "", ".", ".", ",", ";", "!", "?", ")", " |", '"', "'", "\n", " please", " today.", " and nobody else", " (new)", " – thanks",
    ", as agreed", " tomorrow", " bitte", " gracias", " merci", ">", " / backup", " for details.", "\tactive", " since 2019.", " / other",
    ". Then", " or not",
)
#: What may follow a value and tell what it is, with nothing of that kind before it.
TELLS = {
    "email": (" is my inbox", " (e-mail)", " ist meine Adresse", " est mon courriel", " es mi correo"),
    "phone": (" is my mobile", " (cell)", " rings at the desk", " (fax)", ", call any time", " ist meine Nummer", " est mon portable",
    " es mi móvil"),
    "id_number": (" is my passport", " was entered as social security number", " is her tax id", " (passport no.)",
    " ist meine Steuernummer", " est son numéro d’identité", " es mi DNI", " turned out to be an insurance number",
    " stands as identity number", " for his national insurance"),
    "address": (" is where I live", " is our office", " is my home address", " ist meine Anschrift", " est mon adresse",
    " es mi dirección"),
    "person": (" wrote this", " signed it", " is my name", " called twice", " hat unterschrieben", " a signé", " lo firmó"),
}
OPENERS = ("", "", "Well,", "I think", "they put", "we noted", "Then", "it says", "Hier:", "Voilà", "Aquí:", "copied", "line 3:", "-", "*",
    ">")
PERSON_TAILS = (" will join us", " has left", " and I", " said no", " works here", " lives next door", "'s laptop", " hat zugesagt",
    " est absente", " no ha venido", " agreed.", ", our lawyer,", " (they/them)", " is ill", ". Alle Rechte vorbehalten.",
    " and contributors", ", tous droits réservés", ", MD", " replied at once", " who leads it", " et son équipe", " und Team")
AGAINST_LEADS = {
    "numbers": (
        "order", "Order no.", "invoice", "tracking number", "case", "ticket", "transaction", "serial number", "batch", "part number",
        "build", "revision", "sku", "reference", "Bestellung", "Rechnung Nr.", "Auftrag", "commande", "facture", "pedido", "factura",
        "port span", "pid", "epoch", "request_id", "checksum", "version",
        "model", "row", "offset", "total", "code", "line", "isbn", "lot", "counter", "size in bytes", "took", "from", "between", "",
    ),
    "words": ("See", "The", "Read", "In", "Open", "Click", "Under", "Section", "Welcome to", "powered by", "Die", "Der", "Siehe", "Im",
    "La", "Le", "El", "Voir", "Filed by", "Praise for", "Approved by", "Contact", "according to", "title", "label", "team", "", "", "**",
    "# ", "- ", "1. ", "| "),
}
HEADINGS = (
    "Release Quick Start Getting Started Open Source Main Page User Guide Known Issue Limitation Change Log Town Hall Data Set "
    "Project Board Help Desk Night Shift Access Control Security Review Code Owner Issue Tracker Pull Request Beta Program Cloud "
    "Storage Table View Home Menu Support Team Platform "
    "Engineering Group Operations Center Office Suite Green Hotel Grand Central North South East West Lake River Mountain Bridge "
    "Street Market Public License Apache Mozilla Visual Studio Linux Windows Server Docker Python Java Rust Neue Version Bitte "
    "Schritt Fehler Regel Wert Netz Liste Seite Abschnitt Nueva "
    "Guía Página Tabla Lista Nouvelle Page Liste Partie Tableau United Kingdom States New York Monday Tuesday Friday March June "
    "August Steps Notes Summary Overview Example Warning Important Internal Error Null Pointer Exception Client Request Timeout "
    "Default Value Read Write Only First Last Next"
).split()
COMPONENTS = (
    "service plugin adapter library client module driver runtime tool image package agent release chart editor Server Client Cloud Studio "
    "Engine Bridge Suite Gateway Connector"
).split()
ARTICLES = "The Our This Every Any Der Die Das Ein Unser Le La Les Un El Los Una Nuestro".split()
EVERYDAY = (
    "Brown Baker Stone Field King Young Rivers Hill Wood Cook Fisher Marsh Gray Hunter Mason Page Price Rose Bell Cross Frost Lamb Nash "
    "Park Snow Swift West White Woods Winter"
).split()
EVERYDAY_GIVEN = "Mark Will Bill Frank Jack Rose Hope Faith Victor Grant Pat Sue Dawn May Art Gene Josh Penny".split()
ONSETS = "b br c ch d dr f fl g gr h j k kl kr l m n p pr qu r s sch sh sk sl sm st str t th tr v w wh y z".split()
NUCLEI = "a e i o u a e i o ai au ea ee ei ie oa oo ou ue é í ö ü".split()
CODAS = "b ck d ff g k l ll lm ln m n nd ng nt p r rd rk rn rt s sk ss st t th tt x z".split()
STREET_NAMES = (
    "Amber Birch Cedar Dove Elm Fern Granite Hazel Iris Juniper Old Mill Church Station King’s Upper Meadow Linden Rosen Schiller Haupt "
    "Bahnhof Garten Victor Hugo Liberté Moulin Fleurs Mayor Sol Luna Cervantes"
).split()
PLACE_NAMES = (
    "Altmere Brunnau Corvais Dornby Ellow Fontrac Grünbach Hexley Lindau Montrel Néville Valbonne Oakford Köln Lyon Sevilla Bath Leeds "
    "Dresden Nantes"
).split()
# ---- end of fixed values ----


def _made(rng: random.Random, names: list[str], words: list[str]) -> list[tuple[str, list[tuple[str, str]]]]:
    """Labelled sentences of random parts and values: (text, [(type, value)])."""
    pick = rng.choice
    d = lambda n: "".join(pick("0123456789") for _ in range(n))
    up = lambda n=1: "".join(pick("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
    blends = sorted({n[: rng.randint(2, max(2, len(n) - 1))] + pick(names)[-rng.randint(1,
        3) :] for n in names for _ in range(3)} - set(names))

    def syllables(n: int) -> str:
        return ("".join(pick(ONSETS) + pick(NUCLEI) for _ in range(n)) + pick(CODAS + [""] * 10)).capitalize()

    def surname() -> str:
        kind = rng.random()
        s = syllables(rng.randint(1, 3)) + (pick(SURNAME_ENDS) if kind < 0.45 else "")
        if 0.45 <= kind < 0.57:
            s = pick(EVERYDAY)
        elif 0.57 <= kind < 0.63:
            s = pick(("O’", "Mc", "Mac", "D’")) + s
        elif 0.63 <= kind < 0.70:
            s = pick(("van ", "de ", "von ", "van der ", "di ", "de la ", "du ")) + s
        elif 0.70 <= kind < 0.76:
            s = s + "-" + syllables(2)
        return s.upper() if rng.random() < 0.1 and " " not in s else s

    def person() -> str:
        kind = rng.random()
        g = pick(names) if kind < 0.5 else pick(blends) if kind < 0.7 else pick(EVERYDAY_GIVEN) if kind < 0.77 else syllables(rng.randint(1, 3))
        form = rng.random()
        sur = surname()
        if form < 0.17:
            return f"{up()}. {sur}"
        if form < 0.37:
            return f"{sur.split()[-1]}, {pick((g, g, up() + '.'))}"
        return f"{g} {up()}. {sur}" if form < 0.55 else f"{g} {sur}"

    def email() -> str:
        g, s = pick((pick(names), pick(blends))).lower(), surname().split()[-1].lower().replace("’", "")
        g, s = (re.sub(r"[^a-z]", "", x) or "info" for x in (g, s))
        local = pick([g + d(2), s + "_" + g, g + "." + s, g + "+" + pick(words), g[0] + s, pick(words) + "-" + pick(words), s])
        dom = pick([["mail", "example"], ["post", "invalid"], ["in", "corp", "example"], ["lab", "test"], [pick(words), "org"],
            [pick(words) + "-" + pick(words), "co", "uk"], [pick(words), "de"]])
        at, dot = pick([("@", ".")] * 6 + [("(at)", "."), (" [at] ", " [dot] "), (" AT ", " DOT "), (" at ", " dot "), ("[at]", "[dot]")])
        return local + at + dot.join(dom)

    def phone() -> str:
        ext = pick([""] * 5 + [f" ext. {d(3)}", f" x{d(4)}", f", ext {d(2)}"])
        a, z = pick("23456789") + d(2), d(4)
        return pick([
            f"+1 {a} {d(3)} {z}", f"+1-{a}-{d(3)}-{z}", f"({a}) {d(3)}-{z}", f"{a}.{d(3)}.{z}", f"{a}{d(3)}{z}", f"{a}-{d(3)}-{z}",
            f"{a} {d(3)} {z}", f"+44 7{d(3)} {d(6)}", f"+44 (0)7{d(3)} {d(3)} {d(3)}", f"07{d(3)} {d(3)} {d(3)}", f"07{d(3)} {d(6)}",
            f"+44 20 {d(4)} {d(4)}",
            f"020 {d(4)} {d(4)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+49 {d(3)} {d(7)}", f"0{d(2)}/{d(8)}", f"0{d(3)} {d(6)}",
            f"0049-{d(2)}-{d(5)}-{d(3)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0033{d(1)}{d(2)} {d(2)} {d(2)} {d(2)}",
            f"0{pick('12345679')} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"+34 {pick('69')}{d(2)} {d(3)} {d(3)}", f"+34 {pick('69')}{d(2)} {d(2)} {d(2)} {d(2)}"]) + ext

    def ident() -> str:
        return pick([
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{up(2)} {d(2)} {d(2)} {d(2)} {pick('ABCD')}",
            f"{up(2)}{d(6)}{pick('ABCD')}", f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), f"{up(2)}{d(7)}", f"{up()}{d(8)}", f"{up()}{d(7)}",
            f"{d(8)}{up()}", f"{d(8)}-{up()}", f"{pick('XYZ')}{d(7)}{up()}", f"{pick('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}",
            d(9)])

    def address() -> str:
        st, pl = pick(STREET_NAMES), pick(PLACE_NAMES)
        n = rng.randint(1, pick((99, 400, 9999)))
        road = pick("Road Lane Close Street Ave Rd Drive Way St Avenue Court Terrace Boulevard Place Hill".split())
        uk = f"{up(pick((1, 2)))}{d(pick((1, 2)))}{pick(('', '', up()))} {d(1)}{up(2)}"
        us = f"{up(2)} {d(5)}"
        de = st.replace("’s", "") + pick(("straße", "str.", "weg", "allee", "platz", "gasse"))
        return pick([
            f"{pick(('Flat', 'Apt', 'Unit'))} {rng.randint(1, 60)}, {n} {st} {road}, {pl} {uk}", f"{n} {st} {road}, {pl}",
            f"{n} {st} {road}, {pl} {uk}", f"{n} {st} {road}, {pl}, {uk}", f"{n} {st} {pick(STREET_NAMES)} {road}, {pl}, {us}",
            f"{n} {st} {road}, Suite {d(3)}, {pl}, {us}", f"{n} {st} {road}",
            f"{n}{pick(('', ' bis', ' ter'))}{pick((',', ''))} {pick(('rue', 'avenue', 'boulevard', 'place'))} {pick(('des', 'du', 'de la', 'de'))} {st}, {d(5)} {pl}", f"{n} rue {st}",
            f"Calle {pick(('del ', 'de la ', ''))}{st} {n}, {pick(('', f'{d(1)}.º {up()}, '))}{d(5)} {pl}",
            f"{pick(('Avenida', 'Plaza', 'Paseo'))} {pick(('de ', ''))}{st} {n}",
            f"{de} {rng.randint(1, 180)}{pick(('', 'a', ' b'))}, {d(5)} {pl}", f"{de} {rng.randint(1, 180)}"])

    def number() -> str:
        """Numbers in the shapes of phone and identity numbers that are neither, and others."""
        return pick([ident, ident, lambda: f"{d(4)}-{d(4)}-{d(2)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: d(rng.randint(6, 12)),
            lambda: f"{d(6)}.{d(3)}.{d(1)}", lambda: f"{d(4)}-{d(4)}", lambda: f"20{d(2)}-0{d(1)}-1{d(1)}",
            lambda: f"20{d(2)}-0{d(1)}-1{d(1)} 10:4{d(1)}:0{d(1)}.{d(3)}",
                     lambda: f"10.{d(2)}.{d(1)}.{d(3)}:{d(4)}", lambda: f"{rng.getrandbits(160):040x}",
                         lambda: f"0x{rng.getrandbits(64):x}", lambda: f"{d(2)}:{d(2)}:{d(2)}.{d(3)}", lambda: f"{up(2)}-{d(3)}-{d(3)}",
                         lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: d(10)])()

    version = lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 12)}"
    title = lambda: pick((pick(HEADINGS), pick(HEADINGS), pick(words).capitalize()))
    noun = lambda: pick((title(), title(), syllables(2) + pick(ABSTRACT_ENDS)))
    heading = lambda: pick((
        " ".join(title() for _ in range(rng.randint(2, 3))), f"{title()} {noun()}", f"{noun()} {title()}",
        f"{noun()} {pick(('der', 'de', 'del', 'la', 'di', 'von', 'van', 'den', 'of', 'and', 'für', 'und'))} {noun()}"))
    product = lambda: pick([
        f"{pick(names)} {pick(COMPONENTS)}", f"{pick(names)} {version()}",
        f"{pick(ARTICLES)} {pick((pick(names), pick(blends), syllables(2)))} {pick(COMPONENTS)}",
        f"{pick(words).capitalize()} {pick(COMPONENTS)}", f"{pick(HEADINGS)} {pick(COMPONENTS).capitalize()} {version()}",
        f"{pick(names)}-{pick(words)} {version()}"])
    package = lambda: pick([
        f"@{pick(words)}/{pick(words)}@{version()}", f"{pick(words)}-{pick(words)}@{pick(('latest', version()))}",
        f"git@{pick(words)}.example:{pick(words)}/{pick(words)}.git", f"ssh://git@{pick(words)}.example/x.git",
        f"postgres://{pick(words)}@{pick(words)}.example/main",
        f"images.example/{pick(words)}@sha256:{rng.getrandbits(256):064x}", f"https://{pick(words)}.example/@{pick(words)}",
        f"@{pick(words)}", f"<{pick(('email', 'name', 'phone'))}>", f"{pick(words)} at {pick(words)}.{pick(words)}",
        f"{pick(words)}@{pick(words)}"])
    makers = {"email": email, "phone": phone, "id_number": ident, "address": address, "person": person}
    filler = lambda: " ".join(pick(words) for _ in range(rng.randint(2, 6)))
    out = []
    for i in range(TRAINING_SENTENCES):
        before = filler().capitalize() + pick((" ", ". ", ", ", ": ", "\n")) if rng.random() < 0.25 else ""
        if i % 9 < 5:
            kind = TYPES[i % 9]
            value, lead = makers[kind](), pick(LEADS[kind])
            if not lead and (value.isdigit() or re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{4}", value)):  # such need to be announced
                lead = pick([x for x in LEADS[kind] if x])
            tail = pick(PERSON_TAILS) if kind == "person" and rng.random() < 0.4 else pick(TAILS)
            lead = lead.lower() if rng.random() < 0.1 else lead
            join = "" if not lead or lead.endswith("\n") else pick(JOINS)
            plain = not re.fullmatch(r"[\d -]*|[A-Z]{1,2}\d+[A-Z]?", value)  # what says by its form what it is
            if rng.random() < 0.12 or (plain and rng.random() < 0.12):
                lead = pick(OPENERS)
                tail = pick(TAILS if plain and rng.random() < 0.5 else TELLS[kind]) + pick((".", ",", "", "!", "\n"))
                join = " " if lead else ""
            elif kind == "person" and re.search(r"[a-z]$", lead) and join == " " and rng.random() < 0.3:
                value, lead = makers[kind](), pick(("", "As", "When", "If", "Then", "and", "Dr.", "Although", "Wenn", "Quand", "Cuando"))
                join = " " if lead else ""
            text, truth = before + lead + join + value + tail, [(kind, value)]
        else:
            what = pick(("numbers", "numbers", "words", "words", "products", "packages"))
            value = {"numbers": number, "words": heading, "products": product, "packages": package}[what]()
            lead = pick(AGAINST_LEADS["numbers" if what == "numbers" else "words"])
            lead = lead.capitalize() if rng.random() < 0.3 else lead
            if not lead and what == "numbers":
                lead = pick([x for x in AGAINST_LEADS[what] if x])
            text, truth = before + lead + (pick(JOINS) if lead else "") + value + pick(TAILS), []
        out.append((text, truth))
    # Neighbouring sentences give contexts that aren't all empty.
    return [(a[0] + pick((" ", " ", "\n", ". ")) + b[0], a[1] + b[1]) for a, b in zip(out, rng.sample(out, len(out)), strict=True)]


@lru_cache(maxsize=8)
def detector_of(names: tuple[str, ...], vocabulary: str = VOCABULARY) -> Detector:
    """The detector of a lexicon; training is deterministic, so a process does it once."""
    return Detector(list(names), ordinary_words(vocabulary))


class Detector:
    """Trained models and thresholds of all types; plain arrays, sent to workers once."""

    def __init__(self, names: list[str], words: frozenset[str] | None = None, seed: int = 7):
        names = sorted(set(names)) or ["Ada", "Berta", "Carl"]
        words = ordinary_words() if words is None else words
        self.lexicon = Lexicon(names, words)
        rng = random.Random(seed)
        rows: dict[str, list] = {k: [] for k in TYPES}
        for text, truth in _made(rng, names, sorted(w for w in words if w.isascii() and len(w) > 3)):
            want = set(truth)
            found = propose(text)
            shield = _shields(found, text)
            for kind, a, b in found:
                rows[kind].append((features(text, kind, a, b, self.lexicon, _within(shield, a, b, kind)), (kind, text[a:b]) in want))
        self.models, self.cuts = {}, {}
        for kind, got in rows.items():
            x, y = np.array([g[0] for g in got]), np.array([g[1] for g in got], float)
            held = np.arange(len(y)) % 4 == 3  # a quarter calibrates the threshold
            model = Boosted().fit(x[~held], y[~held])
            self.models[kind] = model
            self.cuts[kind] = threshold(model.probability(x[held]), y[held], PRECISION)

    def detect(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """Accepted, non-overlapping (type, start, end) of each text."""
        where: dict[str, list] = {k: [] for k in TYPES}
        rows: dict[str, list] = {k: [] for k in TYPES}
        for i, text in enumerate(texts):
            if not text:
                continue
            found = propose(text)
            shield = _shields(found, text)
            for kind, a, b in found:
                rows[kind].append(features(text, kind, a, b, self.lexicon, _within(shield, a, b, kind)))
                where[kind].append((i, a, b))
        accepted: list[list] = [[] for _ in texts]
        for kind in TYPES:
            if rows[kind]:
                p = self.models[kind].probability(np.array(rows[kind]))
                for (i, a, b), q in zip(where[kind], p, strict=True):
                    if q >= self.cuts[kind]:
                        accepted[i].append((kind, a, b, q))
        return [_settle(x) for x in accepted]


#: What makes a package or a remote of the word before it.
_PACKAGE = re.compile(r"@(?:(v?\d[\w.]*)|[\w.-]+:\S*)")


def _packages(text: str) -> Iterator[tuple[int, int]]:
    """Spans of package specs (name@version) and remotes (git@host:path)."""
    for m in _PACKAGE.finditer(text):
        a = m.start()
        while a and (text[a - 1].isalnum() or text[a - 1] in "_./-"):
            a -= 1
        if a < m.start() and (m[1] or text.endswith("git", a, m.start())):
            yield a - (text[a - 1 : a] == "@"), m.end()


def _shields(found: list, text: str) -> list[tuple[int, int]]:
    """Spans of e-mail addresses and packages, in order: names inside aren't persons."""
    out = [(a, b) for k, a, b in found if k == "email"]
    if "@" in text:
        out += _packages(text)
    return sorted(out)


def _within(shield: list[tuple[int, int]], a: int, b: int, kind: str) -> bool:
    if not shield or kind == "email":
        return False
    k = bisect_left(shield, (b, 0))
    return any(x < b and a < y for x, y in shield[max(0, k - 3) : k])


#: Surer kinds first where accepted spans of different types overlap.
_RANK = {"email": 0, "address": 1, "phone": 2, "id_number": 3, "person": 4}


def _settle(spans: list) -> list[tuple[str, int, int]]:
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []
    for kind, a, b, _ in sorted(spans, key=lambda s: (round(-s[3], 1), _RANK[s[0]], s[1] - s[2], s[1])):
        k = bisect_left(taken, (b, 0))
        if all(not (x < b and a < y) for x, y in taken[max(0, k - 1) : k + 1]):
            taken.insert(bisect_left(taken, (a, b)), (a, b))
            out.append((a, b, kind))
    return [(k, a, b) for a, b, k in sorted(out)]


SCHEMA = "doc_id long, redacted string, found array<struct<pii_type:string,pii_value:string,start:int,stop:int>>"
_FOUND = pa.list_(pa.struct([("pii_type", pa.string()), ("pii_value", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("redacted", pa.string()), ("found", _FOUND)])
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    for kind, a, b in reversed(spans):
        text = text[:a] + PLACEHOLDERS[kind] + text[b:]
    return text


def scan_texts(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name: str = "given_name",
    vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, redacted, found): texts with typed placeholders, and what they replace.

    Positions count characters. Null texts stay null and hold nothing, as do empty ones;
    whole texts are scanned whatever their length. ``names`` is a small fixed lexicon; an
    empty one leaves only the shapes of names. Other columns are ignored.
    """
    known = names.select(F.col(f"`{name}`").alias("n")).where("n IS NOT NULL").distinct()
    if (known.select(F.sum(F.octet_length("n"))).first()[0] or 0) > LEXICON_BYTES:
        raise ValueError(f"more than {LEXICON_BYTES} bytes of given names")
    detector = detector_of(tuple(sorted(r["n"] for r in known.collect())), vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):  # few whole texts at a time
                ids, part = b.column(0).slice(start, 500), b.column(1).slice(start, 500).to_pylist()
                spans = detector.detect(part)
                yield pa.record_batch(
                    [
                        ids.cast(pa.int64()),
                        pa.array([t if not s else redact(t, s) for t, s in zip(part, spans, strict=True)], pa.string()),
                        pa.array([[{"pii_type": k, "pii_value": t[a:z], "start": a, "stop": z} for k, a, z in s] for t,
                            s in zip(part, spans, strict=True)], _FOUND),
                    ],
                    schema=_OUT,
                )

    return python_input(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).mapInArrow(run, SCHEMA)


def cases(scanned: DataFrame) -> DataFrame:
    """(doc_id, pii_type, pii_value): one row per distinct value of a text."""
    return scanned.select("doc_id", F.inline("found")).select("doc_id", "pii_type", "pii_value").distinct()
