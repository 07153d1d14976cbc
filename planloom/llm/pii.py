"""Personal details in free text: located, typed, and replaced by typed placeholders.

Regular expressions propose spans with a first score; checksum validators confirm or
doubt identity numbers; words near a span raise or lower its score. Spans that reach
the threshold stay; of two that overlap the one of the surer type (an email before a
number, a number before an address, an address before a phone, a phone before a name),
within a type the stronger.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: Characters before and after a number whose words count as its context.
BEFORE, AFTER = 40, 24
#: Characters before a verb within which a name's words are looked for.
LONGEST_NAME = 120

SPAN = "pii_type string, start_pos int, end_pos int"

# ---- validators


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Check of an international bank account number."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved.lower())) % 97 == 1


def mod23(card: str) -> bool:
    """Check letter of an eight-digit identity card."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(card[:8]) % 23] == card[-1].upper()


# ---- email

# A sign or its spelling is found first; what stands before and after it makes the address.
_AT, _SPELT_AT = re.compile("@"), re.compile(r"(?<=[\w+%-])(?:\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+)", re.I)
_SPELT_DOT = re.compile(r"\bdot\b", re.I)
_LOCAL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*$")
_DOMAIN = re.compile(r"[A-Za-z0-9][\w-]*(?:\.[A-Za-z0-9][\w-]*)+")
_SPELT_DOMAIN = re.compile(r"[A-Za-z0-9][\w-]*(?:(?:\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)[A-Za-z0-9][\w-]*)+", re.I)


def _emails(text: str) -> Iterator[tuple[int, int, float]]:
    for sign, rest in ((_AT, _DOMAIN), *([(_SPELT_AT, _SPELT_DOMAIN)] if _SPELT_DOT.search(text) else [])):
        for m in sign.finditer(text):
            domain = rest.match(text, m.end())
            if domain and (local := _LOCAL.search(text, max(0, m.start() - 64), m.start())):
                yield local.start(), domain.end(), 1.0


# ---- numbers

#: Runs in which a phone, identity or card number lies; the patterns of these are tried there only.
RUN = re.compile(r"\d[\d ()./-]{7,}[\dA-Za-z]")


def _in_runs(pattern: re.Pattern, text: str, runs: list[tuple[int, int]], before: int = 6, after: int = 4) -> Iterator[re.Match]:
    """Matches of a pattern around the runs; it may begin ``before`` a run, and sees what follows it."""
    done = 0
    for start, end in runs:
        for m in pattern.finditer(text, max(done, start - before), min(len(text), end + after)):
            yield m
            done = m.end()


# ---- phone

PHONE = re.compile(r"(?<![\w.+/#-])(?<!\d )(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ ./-]?)\d{3}[ .-]?\d{4}(?![\w-]|[.]\d)")
#: A plus sign and a country code other than 1, then groups; 8 to 15 digits in all.
ABROAD = re.compile(r"(?<![\w+])\+(?!1[ .(-]?\d{3})[1-9]\d{0,2}(?:[ .-]?\(0?\d{0,4}\)|[ .-]?\d{1,4}){2,7}(?![\w-]|[.]\d)")
_PHONE_WORDS = re.compile(r"\b(?:call(?:ed)?|phone|tel|tél|teléfono|telefono|téléphone|mobile|móvil|cell|fax|reach|hours|contact|contacto|joindre|questions?|watch|dial|voice|ring|per call with|sign-in)\b|[|/]\s*$", re.I)
_NOT_PHONE = re.compile(r"\b(?:part|serial|catalog|model|sheet|po|job|item|sku|section|invoice|account|license|licence|ssn|sin|drawing|replaces|application|submittal|project|no)\b\.?[^.\n]{0,8}$", re.I)
_NOT_PHONE_AFTER = re.compile(r"^\s*(?:fits|replaces|does not|psi|mm|feet|linear)\b", re.I)

# ---- identity numbers

ID_LABEL = (
    r"(?:s\.?s\.?n\.?(?:\s*(?:no\.?|#))?|ss\s?(?:no\.?|#)|social(?:\s+(?:security|insurance))?(?:\s+(?:no\.?|number|#))?|tax\s+id(?:\s+no\.?)?|s\.?i\.?n\.?|i\.?t\.?i\.?n\.?|id\s+card(?:\s+no\.?)?|identity\s+card(?:\s+no\.?)?|"
    r"passport(?:\s+(?:no\.?|number|#))?|driver'?s?\s+licen[cs]e(?:\s+no\.?)?|d\.?l\.?\s?(?:no\.?|#)?|dni|nie|nif|nss|curp|pasaporte|licencia\s+de\s+conducir|passeport|permis\s+de\s+conduire|"
    r"num[ée]ro\s+de\s+s[ée]curit[ée]\s+sociale|seguro\s+social|iban|national\s+id)"
)
_ID_VALUE = r"(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|\d{3}[ -]?\d{2}[ -]?\d{4}|\d{3}[ -]\d{3}[ -]\d{3}|\d{8}-?[A-Z]|[A-Z]-?\d{7,8}|[A-Z]{1,2}\d{6,9}|\d{9}|\d{2}-\d{7})"
# Where a label may begin is found first, cheaply, in lower case.
_LABEL_START = re.compile(r"\b(?:s(?:s|oc|in|\.i|\.s|eg)|tax|i(?:d\s|tin|ban|den|\.t)|pass|pasa|perm|driv|dl|d\.l|dni|ni[ef]|nss|curp|lice|num|nati)")
LABELLED_ID = re.compile(rf"{ID_LABEL}\s*[:#]?\s*(?P<value>{_ID_VALUE})(?![\w-])", re.I)
LONE_ID = re.compile(r"(?<![\w./-])(?P<value>\d{3}-\d{2}-\d{4})(?![\w-])")
# Numbers in a form that a checksum can confirm; the words near them alone don't make them a person's.
CHECKED_ID = re.compile(r"\d(?<![\w./-]\d)(?<!\d \d)(?:\d\d([ -]?)\d{3}\1\d{3}|\d{7}-?[A-Za-z])(?![\w-]| ?\d|\.\d)")
#: Bank accounts, and payment cards in groups of four or unbroken.
ACCOUNT = re.compile(r"(?<![\w/-])(?P<value>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\w-])")
CARD = re.compile(r"(?<![\w./+-])(?<!\d )(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?![\w-]| \d|\.\d)")
_CARD_WORDS = re.compile(r"\b(?:card|visa|mastercard|amex|american express|credit|debit|tarjeta|carte)\b", re.I)
_ID_WORDS_PLAIN = ("ssn", "social", "security", "tax id", "wage form", "payroll", "badge request", "fingerprint")
_ID_WORDS = re.compile(rf"\b(?:{'|'.join(_ID_WORDS_PLAIN)})\b", re.I)
_NOT_ID = re.compile(r"\b(?:serial|part|model|catalog|po|job|application|licence c)\b\W{0,3}(?:no\.?)?\W{0,3}$", re.I)

# ---- address

_DIR = r"(?:north|south|east|west|no|so|n|s|e|w|ne|nw|se|sw)\b\.?"
_TYPE = r"(?:street|strt|str|st|avenue|ave|av|boulevard|blvd|boul|drive|drv|dr|lane|ln|road|rd|court|crt|ct|circle|circ|cir|parkway|pkwy|pky|way|wy|place|pl|terrace|ter|highway|hwy|square|sq|trail|trl|alley|aly)\b"
_UNIT = r"(?:(?:suite|ste|unit|apt|apartment|room|rm)\b\.?\s*#?\s*[a-z]?-?\d+[a-z]?\b|#\s?\d+[a-z]?\b)"
_STATES = (
    r"(?:alabama|alaska|arizona|arkansas|california|colorado|connecticut|delaware|florida|georgia|hawaii|idaho|illinois|indiana|iowa|kansas|kentucky|louisiana|maine|maryland|massachusetts|michigan|minnesota|mississippi|missouri|montana|nebraska|nevada|"
    r"new\s+hampshire|new\s+jersey|new\s+mexico|new\s+york|north\s+carolina|north\s+dakota|ohio|oklahoma|oregon|pennsylvania|rhode\s+island|south\s+carolina|south\s+dakota|tennessee|texas|utah|vermont|virginia|washington|west\s+virginia|wisconsin|wyoming|"
    r"A[LKZR]|C[AOT]|DE|FL|GA|HI|I[DLNA]|K[SY]|LA|M[EDAINSOT]|N[EVHJMYCD]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[TA]|W[AVIY])\b"
)
_ZIP = r"\d{5}(?:-\d{4})?(?![\d-])"
_SEP = r"(?:\s*[,;]\s*|\s+-\s+|[^\S\n]*\r?\n|\s+)"
_NUMBER = r"(?:(?:#|no\.?)\s*)?\d{1,5}"
STREET = re.compile(rf"(?<![\w./:-])\d{{1,5}}\s+(?P<body>(?:{_DIR}\s+)?[^\W\d_][\w'’]*(?:[^\S\n]+[^\W\d_][\w'’]*)?)", re.I)
_LEAD = re.compile(rf"(?<![\w./:#-])(?P<unit>{_UNIT}\s*,\s*)?(?:(?:#|\bno\.?)\s*)?$", re.I)
_FIRST_WORD = re.compile(rf"(?:{_DIR}\s+)?[^\W\d_][\w'’]*", re.I)
_LEADING_DIR = re.compile(rf"^(?:{_DIR}\s+)", re.I)
_STREET_TAIL = re.compile(rf"\s+(?P<type>{_TYPE})\.?(?:\s+{_DIR}(?![\w-]))?|\s+(?:north|south|east|west|[nsew]|so|no)\b\.?(?=\s*(?:,|\n|-\s)|\s+[A-Z][a-z]+[ ,])", re.I)
_ABBREVIATED = re.compile(r"\b(?:str|st|ave|av|blvd|boul|drv|dr|ln|rd|ct|crt|circ|cir|pkwy|pky|wy|pl|ter|hwy|sq|trl|aly|n|s|e|w|no|so|ne|nw|se|sw)$", re.I)
_GOES_ON = re.compile(r"\s+(?:and\s+ask|complained|attention|a\s+nombre|before|after)\b|\s*[,;)]", re.I)
_UNIT_AFTER = re.compile(rf"(?:\s*[,;]\s*|\s+-\s+|\s+){_UNIT}", re.I)
_TOWN = r"(?P<town>[^\W\d_][\w'’]+(?:[^\S\n]+(?:falls|heights|grove|springs|mesa|landing|city|park|beach|hills|valley|village|bay|creek|lake|point|junction|harbor|ridge|[^\W\d_][\w'’]+))?)"
_PLACE_ZIP = re.compile(rf"{_SEP}(?:{_TOWN}{_SEP})?(?:(?P<state>{_STATES}){_SEP})?(?P<zip>{_ZIP})", re.I)
_PLACE_STATE = re.compile(rf"{_SEP}{_TOWN}{_SEP}(?P<state>{_STATES})", re.I)
_PLACE_TOWN = re.compile(rf"(?:\s*[,;]\s*|\s+-\s+|[^\S\n]*\r?\n|[^\S\n]+){_TOWN}(?=\s*(?:[.,;)\n]|$)|\s+(?:complained|and\s+ask|attention|a\s+nombre|before|after))", re.I)
_ADDRESS_WORDS = re.compile(r"\b(?:at|to|en|au|behind|site|where|address|claimant|residing|neighbour|neighbor|vive|livrer|entregar|adresse|dirección|direccion|deliver(?:ies)?|ship|of|lives|resides|habite|home|office)\b[\s:.]*$", re.I)
_NOT_ADDRESS = re.compile(r"\b(?:install|extend|furnish|clean|inspect|replace|job|section|sheet|call box|room|grid|phase|balance|test|hold|provide|fournir|suministrar|within)\b[^.\n]{0,6}$", re.I)
_NOT_STREET_WORDS = set("feet linear inches days minutes degrees diffusers diffuseurs difusores return psi pa mm hours working jours días percent pour north facing existing new of more sheets copies years months weeks".split())

# ---- names

GIVEN = set(
    "mark lena art sunil maria maría chantal grant mason hugh ines inés dale elif tomás tomas priya rené rene anke noor beatriz carter ivo bao luc olga rose chip frank penny dolores kwame tess yuki gwen nuria omar josé jose will "
    "john james robert michael william david richard joseph thomas charles christopher daniel matthew anthony steven paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric "
    "jonathan stephen larry justin scott brandon benjamin samuel gregory alexander patrick raymond jack dennis jerry tyler aaron henry douglas adam peter nathan zachary walter kyle harold carl mary patricia jennifer linda elizabeth "
    "barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca laura sharon cynthia kathleen amy shirley angela helen anna brenda pamela "
    "nicole samantha katherine emma ruth christine catherine debra rachel carolyn janet virginia heather diane julie joyce victoria kelly christina joan evelyn lauren judith olivia martha cheryl megan andrea hannah jacqueline "
    "pierre marie jean michel claire sophie antoine camille carlos juan luis pedro miguel carmen pilar lucia lucía elena sofia sofía diego javier ahmed fatima mohammed ali wei ming li chen yusuf ingrid lars sven hans greta".split()
)
_STOP = set(
    "the and a an of to in on at by for from with or but is was were would shall can could about both ask asked access all any every each this that these those discussion slab washers work room wing wrote confirmed reported "
    "crew starts hold holds residing when where who tel phone mail cc re job scope general notes notas notes générales generales addendum minutes rfi sheet section license licence drawing attention attendees regards thanks superintendent "
    "mr ms mrs mme dr sr sra el la los las le les un une en y et de du des que vive signé signe firma contacto trabajador personne spoke questions certified payroll badge request fingerprint sign-in lien release name social ssn sin passport driver "
    "id dl ss tax abandoned district inspector not alternate response answer contractor part serial model order street avenue boulevard drive lane road court circle parkway way suite unit kitchen library stage gym office corridor building boiler closet server "
    "as per allow install furnish relocate replace inspect label clean support insulate remove provide disconnect commission flush rebalance balance extend coordinate keep ship deliver deliveries test seal verify reach send submit add home reissued see state "
    "retirar suministrar pintar probar coordinar entregar enviar livrer fournir déposer équilibrer écrire coordonner se section contractor minutes work drawing catalog submittal alternate "
    "owner permit set steel duct fan north south east west facing architect architects engineers engineering studio associates partnership group consulting design".split()
)
#: Given names that are verbs or adjectives too: as a second word they begin the next sentence.
_VERB_NAMES = {"will", "mark", "grant", "chip", "frank", "art"}
_PLACE_AFTER = re.compile(r"\s+(?:annex|library|clinic|elementary|civic|high|middle|gymnasium|adult|hall|school|wing|room|building|center|centre|partnership|studio|design|engineers?|engineering|architects?|architecture|associates|consulting|group|street|avenue|drive|lane|road|court|health|unified|property|community|housing)\b", re.I)
_TOKEN = re.compile(r"[A-ZÀ-ÖØ-Þ]\.(?=\s)|[A-ZÀ-ÖØ-Þ](?:[\w]|['’-](?=[A-ZÀ-Þa-zà-ÿ]))*")
_FIRST = r"(?=[A-ZÀ-ÖØ-Þ])"
#: What announces a name, in lower case; the first group of letters is tried at word starts only.
BEFORE_NAME = re.compile(
    r"\b(?:spoke (?:to|with)|questions go to|please contact|attendees:|ask for|attention|attn\.?:?|a nombre de|payroll lists|badge request for|wage form of|lien release from|superintendent|inspector|foreman|"
    r"personne à joindre ?:|contacto:|trabajador(?:a)?:?|who:|call with|(?:mr|ms|mrs|mme|mlle|dr|sr|sra|srta)\.?|m\.|name:?|as|dear|hi|hello|file for|emergency contact:|sign-in sheet:|firma:|signed by:?|prepared by:?|par|por)[^\S\n]+(?=[^\W\d_])"
    r"|\b(?:thanks|regards|sincerely|cordialmente|cordialement|atentamente|merci|gracias),?[^\S\n]*\n(?=[^\W\d_])"
)
_LINE_START_ONLY = {"name", "name:", "as", "dear", "hi", "hello"}
_STARTS = re.compile(r"(?:^|[\n.!?:;])\s*(?:\d{1,3}\.\s+)?$")
_WEAK_BEFORE = re.compile(r"(?i:par|por|as|hi|inspector|foreman)\s+$")
_SECOND = re.compile(r"(?:\s*,\s*|\s+(?i:and|y|et|or)\s+)" + _FIRST)
_AFTER_NAME_PLAIN = ("will hold the", "wrote on", "asked for", "reported the", "confirmed by", "a signé", "s crew")
AFTER_NAME = re.compile(rf"(?:(?<=\s)(?:{'|'.join(_AFTER_NAME_PLAIN[:-1])})|['’]s crew)")
#: Capitalised words; what stands around them is looked at only where they are given names.
_CAPITALISED = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]+")
_BEFORE_WORD, _AFTER_WORD = re.compile(r"[\w'’.-]"), re.compile(r"[\w'’-]")


#: Capitalised words that begin a clause after a name, by their endings and as short words.
_SENTENCE_WORD = re.compile(r"(?:\w+(?:ing|ly|ment|tion|ción)|\w{1,3}|please|after|before|during|since|until|when|what|while|there|here|they|then|our|your|his|her|its|their|only|also|new|two|three|four|five|phase|level|floor|unit|area|hvac|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december)$", re.I)
_NAME_BEFORE = re.compile(r"(?<![\w'’.-])((?:(?:[A-ZÀ-Þ][\w'’-]+|[A-ZÀ-Þ]\.|van|von|de|del|della|da|di|du|la|le|der|den|ter|bin|al|el) )*[A-ZÀ-Þ][\w'’-]+)$")


#: Words within a surname, in any case; each counts only where a capitalised word follows.
_PARTICLE = re.compile(r"(?:(?:van|von|vom|zu|de|del|della|da|di|do|dos|das|du|la|las|los|le|der|den|ter|ten|bin|ibn|ben|al|el|st\.|san|santa) |d['’])+(?=[A-ZÀ-ÖØ-Þ][\w'’-]*[a-zß-ÿ])", re.I)


def read_name(text: str, at: int) -> tuple[int, int] | None:
    """(end, words) of a name that starts at ``at``: all its words, particles and initials to the end of the run, without possessive; None if none."""
    end, words, pos = -1, 0, at
    shout = False
    while True:
        if words and (p := _PARTICLE.match(text, pos)):
            pos = p.end()
        m = _TOKEN.match(text, pos)
        if not m:
            break
        word = m[0]
        stem = re.sub(r"['’][sS]$", "", word)
        if stem.lower() in _STOP or (len(stem) == 1 and word == stem) or (words and stem.lower() in _VERB_NAMES):
            break
        initial = word.endswith(".")
        if not initial:
            # In running capitals, and after a word in another case, a third word may belong to what follows.
            if words == 1:
                shout = len(stem) > 1 and stem.isupper()
            if words >= 2 and (shout or stem.isupper() or not _goes_on(text, pos, stem)):
                break
            end, words = pos + len(stem), words + 1
        elif words > 2:
            break
        pos = m.end()
        if stem != word:
            break
        if text[pos : pos + 1] != " ":
            break
        pos += 1
    return (end, words) if end > 0 else None


def _goes_on(text: str, at: int, stem: str) -> bool:
    """Whether a third or later capitalised word is still the name: it isn't one that begins a sentence or names a firm or place."""
    return not _PLACE_AFTER.match(text, at - 1) and not _SENTENCE_WORD.match(stem)


def read_turned_name(text: str, at: int) -> int | None:
    """End of ``Surname, Given`` at ``at``."""
    m = re.compile(r"([A-ZÀ-Þ][\w'’-]+), ([A-ZÀ-Þ][\w'’-]+)((?: [A-Z]\.)?)(?!\w)").match(text, at)
    if m and m[1].lower() not in _STOP and m[2].lower() not in _STOP and (m[2].lower() in GIVEN or m[1].lower() not in GIVEN):
        return m.end()
    return None


def _names(text: str, lower: str) -> Iterator[tuple[int, int, float]]:
    for m in BEFORE_NAME.finditer(lower):
        at, lead = m.end(), m[0]
        if not text[at].isupper() or (lead.strip() in _LINE_START_ONLY and not _STARTS.search(text[max(0, m.start() - 6) : m.start()])):
            continue
        weak = bool(_WEAK_BEFORE.search(m[0]))
        if re.search(r"file for|emergency contact|sign-in sheet|firma", lead) and (end := read_turned_name(text, at)):
            yield at, end, 0.9
            continue
        while found := read_name(text, at):
            end, words = found
            first = re.split(r"[\s.]", text[at:end])[0].lower()
            if (weak and first not in GIVEN) or _PLACE_AFTER.match(text, end):
                break
            yield at, end, 0.8 if not weak else 0.6
            if not re.search(r"spoke|attendees", lead) or not (n := _SECOND.match(text, end)):
                break
            at = n.end()
    for m in AFTER_NAME.finditer(lower) if any(w in lower for w in _AFTER_NAME_PLAIN) else ():
        start, stop = max(0, m.start() - LONGEST_NAME), m.start()
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        head = _NAME_BEFORE.search(text[start:stop])
        if head:
            at = start + head.start(1)
            while at < stop and (word := _TOKEN.match(text, at)) and word[0].lower() in _STOP:
                at = word.end() + 1
            if at < stop and (found := read_name(text, at)) and found[0] == stop:
                yield at, stop, 0.8
    # A given name, an initial perhaps, and a surname: nearby words decide where the given name is a word too.
    for m in _CAPITALISED.finditer(text):
        if m[0].lower() not in GIVEN or _AFTER_WORD.match(text, m.end()) or (m.start() and _BEFORE_WORD.match(text, m.start() - 1)):
            continue
        found = read_name(text, m.start())
        if found and found[1] >= 2 and not _PLACE_AFTER.match(text, found[0]):
            second = text[m.end() : found[0]].split()[-1]
            shout = text[m.start() : found[0]].isupper()
            calm = not shout or not _is_shouted(text, m.start(), found[0])
            if second[0].isupper() and (calm or re.search(r"[:,]\s*$", text[: m.start()][-3:])):
                yield m.start(), found[0], 0.6


def _is_shouted(text: str, start: int, end: int) -> bool:
    """Whether the text around a span is in capitals too, so that capitals don't mark a name."""
    around = text[max(0, start - 40) : start] + text[end : end + 40]
    letters = [c for c in around if c.isalpha()]
    return bool(letters) and sum(c.isupper() for c in letters) > 0.7 * len(letters)


def _addresses(text: str) -> Iterator[tuple[int, int, float]]:
    for m in STREET.finditer(text):
        first = _LEADING_DIR.sub("", m["body"]).split()
        if not first or first[0].lower() in _NOT_STREET_WORDS:
            continue
        lead_in = _LEAD.search(text, max(0, m.start() - 24), m.start())
        start = lead_in.start() if lead_in else m.start()
        # The body took one or two words; the type is looked for after the first, then after the second.
        body_at = m.start("body")
        lead = _FIRST_WORD.match(text, body_at)
        tail = None
        for stop in (lead.end(), m.end()):
            if t := _STREET_TAIL.match(text, stop):
                tail = t
                break
        end = tail.end() if tail else lead.end()
        score = 0.35 if tail else 0.0
        if u := _UNIT_AFTER.match(text, end):
            end = u.end()
            score += 0.15
        place = _PLACE_ZIP.match(text, end)
        if place and not _state_fits(place, m):
            place = None
        if place:
            end = place.end()
            score += 0.5
        elif (place := _PLACE_STATE.match(text, end)) and _state_fits(place, m):
            end = place.end()
            score += 0.4
        elif (place := _PLACE_TOWN.match(text, end)) and place["town"].split()[0].lower() not in _STOP and (place["town"][0].isupper()):
            end = place.end()
            score += 0.2
        # A full stop belongs to an abbreviation in the middle of a sentence, or before another full stop.
        if text[end - 1] == ".":
            end -= 1
        if text[end : end + 1] == "." and _ABBREVIATED.search(text[max(0, end - 6) : end]) and (text[end + 1 : end + 2] == "." or _GOES_ON.match(text, end + 1)):
            end += 1
        before = _place_before(text, start)
        if before is not None:
            start, score = before, score + 0.4
        if lead_in and lead_in["unit"]:
            score += 0.15
        near = text[max(0, start - BEFORE) : start]
        if _ADDRESS_WORDS.search(near):
            score += 0.3
        if _NOT_ADDRESS.search(near):
            score -= 0.4
        if first[0].lower() in _STOP or any(w.lower() in ("belt", "feet") for w in first):
            score -= 0.6
        yield start, end, score


def _state_fits(place: re.Match, street: re.Match) -> bool:
    """A two-letter state is in capitals, except in an address that is all in lower case."""
    state = place["state"]
    return not state or len(state) > 2 or state.isupper() or street["body"].islower()


_BEFORE_STREET = re.compile(rf"(?<![\w-])(?:(?P<town>[^\W\d_][\w'’]+(?:[^\S\n]+[^\W\d_][\w'’]+)?)(?:\s*,\s*|\s+))?(?:(?P<state>{_STATES})\s*,?\s*)?(?P<zip>{_ZIP})?\s*(?:,|\s-)\s*$", re.I)


def _place_before(text: str, start: int) -> int | None:
    """Start of a town, state or postcode that leads a turned address, else None."""
    from_ = max(0, start - 70)
    head = text[from_:start]
    if not re.search(r"(?:,|\s-)\s*$", head):
        return None
    m = _BEFORE_STREET.search(head)
    if not m or not (m["state"] or m["zip"]):
        # Town alone: only where an address is announced.
        t = re.search(r"(?<![\w-])(?P<town>[A-ZÀ-Þ][\w'’]+(?: [A-ZÀ-Þ][\w'’]+)?)(?:,\s*|\s+-\s+)$", head)
        return from_ + t.start("town") if t and _ADDRESS_WORDS.search(head[: t.start("town")]) and t["town"].split()[0].lower() not in _STOP else None
    at = m.start()
    if m["town"]:
        # The two words before may hold the words that announce the address.
        kept = [w for w in re.finditer(r"\S+", m["town"]) if w[0].lower() not in _STOP and not _ADDRESS_WORDS.search(w[0] + " ")]
        if kept and kept[-1].end() == len(m["town"]):
            at = m.start("town") + kept[0].start()
        else:
            at = m.end("town")
            at += len(head[at:]) - len(head[at:].lstrip(" ,:"))
    return from_ + at


def _phones(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, float]]:
    for m in _in_runs(PHONE, text, runs):
        near, after = text[max(0, m.start() - BEFORE) : m.start()], text[m.end() : m.end() + AFTER]
        score = 0.55 if re.search(r"[().\-/ +]", m[0]) else 0.35
        if _PHONE_WORDS.search(near):
            score += 0.3
        if re.match(r"\s*(?:[|/]|or\b)|\)?\s+on arrival", after):
            score += 0.2
        if re.search(r"[,(:]\s*$", near):
            score += 0.2
        if _NOT_PHONE.search(near) or _NOT_PHONE_AFTER.match(after):
            score -= 0.7
        yield m.start(), m.end(), score


    if "+" in text:
        for m in ABROAD.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                near = text[max(0, m.start() - BEFORE) : m.start()]
                yield m.start(), m.end(), 0.6 + 0.3 * bool(_PHONE_WORDS.search(near)) - 0.3 * bool(_NOT_PHONE.search(near))


def _ids(text: str, lower: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, float]]:
    for at in _LABEL_START.finditer(lower):
        m = LABELLED_ID.match(text, at.start())
        if not m:
            continue
        near = text[max(0, m.start() - BEFORE) : m.start()]
        value = m["value"]
        plain = re.sub(r"[ -]", "", value)
        # A label makes a number a person's by itself; its checksum decides where a word before the label says otherwise.
        score = 0.6
        if re.fullmatch(r"\d{8}[A-Za-z]", plain):
            score += 0.3 if mod23(plain) else 0.0
        elif re.fullmatch(r"[A-Za-z]{2}\d{2}[A-Za-z0-9]{10,}", plain):
            score += 0.3 if mod97(plain) else -0.3
        elif re.fullmatch(r"\d{9}", plain):
            score += 0.3 if luhn(plain) else 0.0
        if _NOT_ID.search(near):
            score -= 0.35
        yield m.start("value"), m.end("value"), score
    for m in _in_runs(LONE_ID, text, runs):
        near = text[max(0, m.start() - BEFORE) : m.start()]
        yield m.start(), m.end(), 0.3 + 0.3 * bool(_ID_WORDS.search(near)) - 0.5 * bool(_NOT_ID.search(near))
    for m in _in_runs(CHECKED_ID, text, runs) if any(w in lower for w in _ID_WORDS_PLAIN) else ():
        near = text[max(0, m.start() - BEFORE) : m.start()]
        if _ID_WORDS.search(near):
            plain = re.sub(r"[ -]", "", m[0])
            confirmed = luhn(plain) if plain.isdigit() else mod23(plain)
            yield m.start(), m.end(), 0.4 + 0.2 * confirmed - 0.5 * bool(_NOT_ID.search(near))
    # Accounts and cards are long enough for their checksum to make them one without a label; a label alone doesn't.
    for m in _in_runs(ACCOUNT, text, runs, 12, 24):
        plain = m["value"].replace(" ", "")
        near = text[max(0, m.start() - BEFORE) : m.start()]
        if 15 <= len(plain) <= 34:
            yield m.start("value"), m.end("value"), 0.3 + 0.4 * mod97(plain) - 0.35 * bool(_NOT_ID.search(near))
    for m in _in_runs(CARD, text, runs):
        plain = re.sub(r"[ -]", "", m[0])
        near = text[max(0, m.start() - BEFORE) : m.start()]
        if 13 <= len(plain) <= 19 and len(set(plain)) > 1:
            yield m.start(), m.end(), 0.2 + 0.3 * bool(_CARD_WORDS.search(near)) + 0.3 * (plain[0] in "23456") + (0.2 if luhn(plain) else -0.4) - 0.4 * bool(_NOT_ID.search(near) or _NOT_PHONE.search(near))


def find_personal(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of each mention, in code points from 0, end exclusive, in order and without overlaps. None for null gives an empty list."""
    if not text:
        return []
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    runs = [m.span() for m in RUN.finditer(text)]
    proposed = (("email", _emails(text)), ("id_number", _ids(text, lower, runs)), ("phone", _phones(text, runs)), ("address", _addresses(text)), ("name", _names(text, lower)))
    spans = [(kind, s, e, w) for kind, found in proposed for s, e, w in found if w >= THRESHOLD]
    rank = {"email": 0, "id_number": 1, "address": 2, "phone": 3, "name": 4}
    spans.sort(key=lambda x: (rank[x[0]], -x[3], x[1] - x[2], x[1]))
    kept: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    for kind, s, e, _w in spans:
        i = bisect.bisect_left(taken, (s, e))
        if (i < len(taken) and taken[i][0] < e) or (i > 0 and taken[i - 1][1] > s):
            continue
        taken.insert(i, (s, e))
        kept.append((kind, s, e))
    return sorted(kept, key=lambda x: x[1])


def redact(text: str | None) -> str | None:
    """The text with each mention replaced by ``[TYPE]``; all else, white space included, unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in find_personal(text):
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def personal_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pii_type, start_pos, end_pos) of each mention; positions in code points from 1, end inclusive.

    Null and empty texts have none; texts of any length are read whole, each alone, so
    no key or group can be hot; repeated rows repeat their mentions; other columns don't matter.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, kind, s + 1, e) for k, t in zip(b["_key"], b["_text"]) for kind, s, e in find_personal(t)]
            yield pd.DataFrame(rows, columns=["_key", "pii_type", "start_pos", "end_pos"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") > 0).mapInPandas(find, f"_key {kind}, {SPAN}").withColumnRenamed("_key", key)


def redacted(docs: DataFrame, text: str, out: str = "redacted") -> DataFrame:
    """``docs`` with column ``out``: the text with typed placeholders; null stays null."""

    @F.pandas_udf("string")
    def swap(s: pd.Series) -> pd.Series:
        return s.map(redact, na_action="ignore")

    return docs.withColumn(out, swap(F.col(text)))
