"""Formats of personal data: used to label training text and as the exact check on decoded spans."""

from __future__ import annotations

import re

KINDS = ("email", "phone", "id_number", "address", "name")

_AT = r"(?:@|\s?[\[({<]\s?(?:at|arroba|arobase)\s?[\])}>]\s?|\s(?:at|arroba|arobase)\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|punto|point|punkt)\s?[\])}>]\s?|\s(?:dot|punto|point|punkt)\s)"
EMAIL = re.compile(
    rf"(?<![\w.+%@/-])[\w][\w.+%-]*{_AT}[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z0-9][\w-]*)*{_DOT}[A-Za-z]{{2,}}(?![\w@/-])",
    re.I,
)
_NOT_MAIL = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|js|css|py|go|java)$|^git@", re.I)

PHONE = re.compile(
    r"(?<![\w.+/@#=-])(?:phone=|tel[.:=]+)?("
    r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,4}(?:[ ./-]?\d{2,8}){1,5}"
    r"|00\d{2}[ .-]?\d{2,4}(?:[ .-]?\d{2,8}){1,5}|00\d{11,12}"
    r"|\(0?\d{2,4}\) ?\d{3,8}(?:[ -]\d{2,5}){0,2}"
    r"|0\d{2,4}/\d{5,9}|0\d{2,3} \d{7,8}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}"
    r"|0\d(?:[ .-]\d{2}){4}"
    r"|[2-9]\d{2}[.-]\d{3}[.-]\d{4}|1[ .-]?[2-9]\d{2}[ .-]?\d{3}[ .-]?\d{4}"
    r"|[6-9]\d{2}[ .-]\d{3}[ .-]\d{3}|[6-9]\d{2}(?: \d{2}){3}"
    r")(?:(?:,? ?(?:ext|x|Durchwahl|poste|extensión)\.? ?)\d{1,5})?(?!\d|[.-]\d|\w)",
    re.I,
)

_ID_LABEL = (
    r"(?:SSN|social security (?:number|no\.?)|passport (?:no\.?|number)|NINO|NI number|national insurance (?:no\.?|number)"
    r"|Steuer-?ID|steuerliche Identifikationsnummer|Ausweisnummer|Personalausweis(?:nummer)?|Reisepass(?:nummer)?|Passnummer"
    r"|NIR|numéro de sécurité sociale|n° de sécurité sociale|numéro de passeport|passeport n°|carte d[’']identité(?: n°)?"
    r"|DNI|NIE|NIF|número de pasaporte|pasaporte(?: n[º.o]+)?|número de la seguridad social)"
)
ID_NUMBER = re.compile(
    rf"(?<![\w+-])(?:{_ID_LABEL}[:#]? ?(?:[A-Z]?\d[\d .-]{{6,19}}\d(?:-?[A-Z])?|[A-Z0-9]{{8,10}}|[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D])"
    r"|\d{3}-\d{2}-\d{4}"
    r"|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|\d{8}-?[A-HJ-NP-TV-Z]|\d{2}\.\d{3}\.\d{3}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-HJ-NP-TV-Z]"
    r"|[12] \d{2} (?:0[1-9]|1[0-2]) \d{2} \d{3} \d{3} \d{2}|[12]\d{2}(?:0[1-9]|1[0-2])\d{10}"
    r"|L[A-Z0-9]{8}(?<=\d.)|L[A-Z0-9]*\d[A-Z0-9]*(?<=L.{8})"
    r"|\d{2} \d{3} \d{3} \d{3}"
    r")(?![\w-]|\.\d)",
    re.I,
)
#: Words before a number that make it something else.
_NOT_ID_BEFORE = re.compile(
    r"(?:build|job|part(?: number)?|lot|lote|lauf|charge|ticket|run|batch(?: no\.)?|version|invoice|case|change|port|trace|commit|checksum|teil(?:enummer)?|pieza|pièce|referencia|ref\.?|order|serial)[ #:]*$",
    re.I,
)

_CAP = r"[A-ZÀ-ÖØ-ÞŒ][\wÀ-ÿ’'.-]*"
_EN_ST = r"(?:Street|St|Close|Lane|Ln|Road|Rd|Avenue|Ave|Boulevard|Blvd|Court|Ct|Terrace|Drive|Dr|Way|Place|Pl|Square|Sq|Crescent|Row|Mews|Gardens)"
_FR_ST = r"(?:rue|avenue|av\.?|boulevard|bd\.?|impasse|chemin|place|allée|allee|quai|route|cours|passage|square|sentier|voie)"
_ES_ST = r"(?:C/|Calle|Camino|Avda\.?|Avenida|Av\.|Paseo|P\.º|Plaza|Pl\.|Ronda|Travesía|Carretera|Ctra\.)"
ADDRESS = re.compile(
    rf"(?<![\w.-])(?:"
    rf"(?:(?:Flat|Apt|Unit|Suite) \d+[A-Za-z]?, )?\d{{1,4}}[a-z]? (?:{_CAP} ){{1,3}}{_EN_ST}\b\.?(?!\s+cluster)"
    rf"|\d{{1,4}}(?: ?(?:bis|ter|[a-dA-D]))?,? {_FR_ST} (?:de la |de l[’']|du |des |de |d[’']|aux? |à la )?{_CAP}"
    rf"|(?:{_CAP} )?(?:{_CAP}(?:straße|strasse|weg|gasse|platz|allee|ufer|damm|ring|steig|str\.)|{_CAP} (?:Str\.|Straße|Strasse|Weg|Gasse|Platz|Allee)"
    rf"|(?:Am|An der|An den|Im|Zum|Zur|Auf der|Auf dem|Unter den|In der|In den|Hinterm|Hinter der|Hinter dem|Vorm|Vor dem|Vor der|Beim|Bei der|Überm) (?:[a-zäöü]+ )?{_CAP}) \d{{1,4}} ?[a-z]?(?!\w)"
    rf"|{_ES_ST} ?(?:del |de la |de los |de las |de )?{_CAP}(?: {_CAP})*,? ?(?:n[º°o.]+ ?|núm\. ?)?\d{{1,4}}(?!\w|[.]\d)"
    rf")",
    re.I | re.U,
)

#: The word before the number at the end.
_NUMBERED = re.compile(r"([^\W\d_][\w’'.-]*),?\s+(?:n\S*\s?)?\d{1,4} ?[a-zA-Z]?$")

_W = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
TITLE = r"(?:Mrs|Mr|Ms|Miss|Dr|Prof|Sir|Herrn?|Frau|Fräulein|Monsieur|Madame|Mademoiselle|M|Mme|Mlle|Me|Don|Doña|Señora|Señorita|Señor|Sra|Sr|Srta)"
NAME_SHAPE = re.compile(
    rf"(?:{TITLE}\.?\s+(?:{TITLE}\.?\s+)?(?:{_W}|[^\W\d_]\.)(?:\s+(?:{_W}|[^\W\d_]\.)){{0,3}}"
    rf"|{_W}(?:\s+(?:{_W}|[^\W\d_]\.)){{1,3}}|{_W},\s+{_W}(?:\s+(?:{_W}|[^\W\d_]\.)){{0,2}}|[^\W\d_]\.\s+{_W})",
    re.I,
)
#: Words that are no part of a person's name: names of products, things and roles, and function words.
NOT_NAME = frozenset(
    """metrics jenkins notation cluster street close lane court road avenue route port page build release version bot gateway
    queue pipeline section article artikel invoice ticket case run batch change the and from that this with for was has had not
    which who said team policy platform review reviewer scanner report rule filter nightly weekly prompt audit kafka redis
    docker kubernetes grafana prometheus python java javascript django flask apache spark server studio code hub cloud index
    tree search service api sort hash filter code cache test suite manager system engine machine drive framework library
    le la les des une un der die das ein eine und el los las del una que para con por sin est und oder wird
    hat war is are a à y et de du an von zu im in on at to by of auf dem den mit bei nach vor für über unter sich ich sie er wir nicht oder aber
    steht geht kommt wird goes went was were has have had pour dans sur avec est ont fue son está están entre sobre""".split()
)


def email_ok(s: str) -> bool:
    m = EMAIL.fullmatch(s.strip(" <>,;:()\"'"))
    return bool(m) and not _NOT_MAIL.search(m[0])


def name_ok(s: str) -> bool:
    """A title with a surname, or at least two words neither of which is a common one."""
    s = s.strip(" .,;:()\"'")
    if not NAME_SHAPE.fullmatch(s):
        return False
    words = [w for w in re.findall(r"[^\W\d_]+", s)]
    title = re.match(rf"{TITLE}\.?\s", s, re.I)
    rest = [w for w in words if not re.fullmatch(TITLE, w, re.I)] if title else words
    if any(w.lower() in NOT_NAME for w in rest):
        return False
    long = [w for w in rest if len(w) > 1]
    return len(long) >= (1 if title else 2)


#: Words that count or measure, beside a number no street.
NOT_ADDRESS = frozenset("page pages section line lines port version build run batch step room item items file files times attempts seconds minutes hours days percent seite seiten zeile artikel version als nach versuchen dateien treffern millisekunden sekunden minuten stunden tagen einträgen página línea artículo intentos ficheros segundos minutos horas días ligne article fichiers secondes tentatives heures jours".split())
_SEPARATORS = str.maketrans("", "", " .-/()+\u00a0\u2007\u202f")


def plausible(s: str, kind: str) -> bool:
    """What every item of a kind has, whatever its format."""
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        return bool(re.search(r"\w\s?(?:@|\W?\b(?:at|arroba|arobase)\b\W?)\s?\w.*(?:\.|\b(?:dot|punto|point|punkt)\b)\W*[^\W\d]{2,}", s, re.I))
    if kind == "address":  # words and a number, or a number and words
        words = re.findall(r"[^\W\d_]+", s)
        if 2 * sum(w[0].isupper() for w in words) <= len(words) and len(words) > 1 or any(w.lower() in NOT_ADDRESS for w in words):
            return False
        return bool(re.fullmatch(r"\W*(?:(?:[^\W\d_][\w’'.-]*\s+){1,6}\d{1,4} ?[a-zA-Z]?|\d{1,4} ?[a-zA-Z]?,?(?:\s+[^\W\d_][\w’'.-]*){2,6})\W*", s))
    bare = s.translate(_SEPARATORS)
    if kind == "phone":
        return 9 <= digits <= 15 and bare.isdigit()
    return 7 <= digits <= 15 and 1 <= len(bare) - digits <= 4 and bare.isalnum() or 10 <= digits <= 15 and bare.isdigit()


def exact(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str]]:
    """Spans of the formatted kinds that are asked for; earlier kinds win where they overlap."""
    out: list[tuple[int, int, str]] = []

    def put(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, kind))

    if "email" in kinds:
        for m in EMAIL.finditer(text):
            if not _NOT_MAIL.search(m[0]):
                put(m.start(), m.end(), "email")
    if "address" in kinds:
        for m in ADDRESS.finditer(text):
            before = _NUMBERED.search(m[0])  # a street has a capital, unless nothing around has
            if not before or before[1][0].isupper() or not any(c.isupper() for c in m[0]):
                put(m.start(), m.end(), "address")
    if "id_number" in kinds:
        for m in ID_NUMBER.finditer(text):
            if not _NOT_ID_BEFORE.search(text[max(0, m.start() - 20) : m.start()]) and any(c.isdigit() for c in m[0]):
                put(m.start(), m.end(), "id_number")
    if "phone" in kinds:
        for m in PHONE.finditer(text):
            digits = sum(c.isdigit() for c in m[1])
            if 9 <= digits <= 15 and not _NOT_ID_BEFORE.search(text[max(0, m.start() - 20) : m.start()]):
                put(m.start(1), m.end(), "phone")
    return sorted(out)
