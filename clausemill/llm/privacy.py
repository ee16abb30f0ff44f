"""Personal information in free text: finding, placeholders and keyed surrogates.

Finding works on a copy of the text in which wide and typographic forms of digits,
signs and blanks stand as ASCII, character for character, so offsets hold.  Names
are told by cues, titles, common given names and the list of known tokens, extended
by the word forms that the list's family names are made of; a name that goes on as the
name of a company, building or street is none.  Names in Cyrillic, Han and other
scripts are told by their own cues and titles.

Replacing gives each entity either a typed placeholder, numbered by first mention, or
a surrogate drawn by key: of the same kind, format, letter case, width and script, the
same for every mention of an entity in the whole corpus (coreference), different for
different entities of the corpus and never one of its originals.  Given names keep
their gender: it is voted by the titles before them in the whole corpus (Mr, Ms and the
like), else taken from a list of common names; surrogates of women's names end in -a,
of men's in a consonant, of unknown ones and of family names in another way.  Numbers
are permuted, words composed of syllables; what meets all the same is found by a join
over the distinct entities and drawn again.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from clausemill.session import cut

KINDS = ("email", "phone", "id_number", "address", "name")
#: Name tokens that are broadcast; the list is a small reference table, a larger one is refused.
NAME_LIST_MOST = 500_000

_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | dict.fromkeys([0xA0, 0x2007, 0x202F, 0x2009, 0x3000], 0x20) | dict.fromkeys([0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212], 0x2D) | {0x2019: 0x27, 0x02BC: 0x27}

_MARK = re.compile(r"@|[\[(] ?at ?[\])]|(?<=\w) at (?=[A-Za-z0-9\-]+ dot [A-Za-z])", re.I)
_LOCAL_SIGNS = frozenset("._%+'-")
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+'\-]*[A-Za-z0-9_+\-])?(?=\s?$)")
_DOT = r"(?:\.|\s?[\[(] ?dot ?[\])]\s?| dot )"
_DOMAIN = re.compile(rf"\s?([A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,24}})(?![A-Za-z0-9])", re.I)

_PHONE = re.compile(
    r"(?:\+\d{1,3}[ .\-]?(?:\(\d{2,4}\) ?|\d{2,4}[ .\-/]?)\d{3,4}[ .\-]?\d{3,4}|(?<![\w\-.,/+$#])(?:1[ .\-])?(?:\(\d{3}\) ?|(?<!\()\d{3}[ .\-/]?|(?<=\()\d{3}[ .\-/]?)\d{3}[ .\-]?\d{4})(?![\w])(?!-\d)(?:,? ?(?:ext|x)\.? ?\d{1,6})?"
)
_NO_PHONE = re.compile(r"(?:parcel|drawing|invoice|loan|serial|file|permit|account|meter|folio|plat|deed|order|case|docket|model|lot|sheet|policy|claim|record|instrument|reference|tax)s?(?: identification)?(?: is)?(?: (?:no|nos|number|id)\b\.?)?[:#]? ?$", re.I)

_ID = re.compile(
    r"\b(?:SSN|S\.S\.N\.|ITIN|social security(?: (?:number|no\.?|#))?|soc\. ?sec\.(?: (?:number|no\.?))?|(?:individual )?taxpayer(?: identification)?(?: (?:number|no\.?|id))|passport(?: (?:number|no\.?))?|driver'?s?'? licen[cs]e(?: (?:number|no\.?))?|D\.L\.(?: (?:number|no\.?))?)"
    r"\s?[:#]?\s?((?=[A-Z0-9\- .]*\d)(?:\d{3}[ .\-]?\d{2}[ .\-]?\d{4}|[A-Z]{1,2}\d{6,9}|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]?\d{1,4}(?:-\d{2,5}){2,3}))(?![\w])",
    re.I,
)

_SUFFIX = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr|Court|Ct|Place|Pl|Terrace|Ter|Parkway|Pkwy|Way|Circle|Cir|Highway|Hwy|Square|Sq|Trail|Trl|Alley|Crescent|Row|Walk"
_NUMBER = "One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve|Thirteen|Fourteen|Fifteen|Sixteen|Seventeen|Eighteen|Nineteen|Twenty"
_PLACE = r"(?!(?:IN|OF|AT|AND|FOR|THE|TO|ON|WITHIN|MILES|DAYS|MONTHS|STALLS|At|In|Of|The|And|On)\b)(?:[A-Z][a-z'\-]+|[A-Z][A-Z'\-]+|\d{1,3}(?:st|nd|rd|th))"
_ADDRESS = re.compile(
    rf"(?<![\w\-.,$/#+])(?:\d{{1,6}}(?:-?[A-Z]|-\d{{1,4}})?(?: 1/2| \u00bd|\u00bd)?|{_NUMBER}|{_NUMBER.upper()}) (?:(?:North|South|East|West|NORTH|SOUTH|EAST|WEST|[NSEW]\.?|[NS][EW]\.?)\s)?(?:{_PLACE}\s){{1,3}}?(?:{_SUFFIX}|{_SUFFIX.upper()})\b\.?"
)
_NO_HOUSE = re.compile(r"(?:suite|unit|bay|space|floor|room|section|article|paragraph|exhibit|sheet|sec|lot|parcel|no|stalls?|chapter|page|box|apt|ste)\.? ?$", re.I)

_UP, _LO = "A-Z\u00c0-\u00d6\u00d8-\u00de", "a-z\u00df-\u00f6\u00f8-\u00ff"
_WORD = rf"(?:(?:O'|D'|Mc|Mac|De|La|Le|Van)?[{_UP}][{_LO}]+|(?:O'|D'|MC|MAC)?[{_UP}]{{2,}})"
_FAMILY = rf"{_WORD}(?:-{_WORD})?"
_INITIAL = rf"[{_UP}]\."
_TITLE = r"(?:(?:Mr|Mrs|Ms|Mx|Dr|Prof|Rev|Hon|MR|MRS|MS|DR|PROF)\.|Miss|Sir|Dame|Mister|Madam|Mr|Mrs|Ms|Dr|Prof) "
_NAME = rf"(?:{_FAMILY}, {_WORD}(?: {_INITIAL})?|{_INITIAL} ?(?:{_INITIAL} ?)?{_FAMILY}|{_WORD} (?:{_INITIAL} )*{_FAMILY})"
_CUES = [c + e for w in ("Attn", "ATTN", "Attention", "ATTENTION", "By", "BY", "Name", "NAME", "Witness", "witness", "WITNESS", "Applicant", "APPLICANT", "contact", "contacts", "Contact", "Contacts", "CONTACTS", "Signed", "Tenant", "Guarantor") for c, e in ((w, ": "), (w, ":"))] + [
    w for x in ("attention ", "handed to ", "guarantor ", "appointed ", "prior tenant, ", "key holder is ", "returned by ", "contact person ", "care of ", "c/o ", "my name is ", "met with ", "spoke with ", "signed by ", "dear ", "sincerely, ", "attn ", "on behalf of ", "deponent ", "affiant ") for w in (x, x.upper(), x.capitalize())
]
_CUED = re.compile(rf"({_TITLE})?({_NAME}|{_FAMILY})")
_AND = re.compile(rf" (?:and|AND|&) ({_TITLE})?({_NAME}|{_FAMILY})")
_TITLES = [t + e for t in ("Mr", "Mrs", "Ms", "Mx", "Dr", "Prof", "Rev", "Hon", "MR", "MRS", "MS", "DR", "PROF", "Mme") for e in (". ", " ", ".")] + ["Miss ", "Sir ", "Dame ", "Mister ", "Madam "]
_TITLED = re.compile(rf" ?((?:{_INITIAL} ?)*(?:{_WORD} (?:{_INITIAL} )*)?{_FAMILY})")
_TAILS = [" signed as guarantor", " SIGNED AS GUARANTOR", " as its site contact", " AS ITS SITE CONTACT", ", Managing Member", ", residing at", ", whose SSN", ", whose Soc", ", whose soc", ", whose tax", ", whose pass", ", whose Pass", ", whose driver", ", whose D.L.", " | Title:"] + [f" {c}" for c in ("((", "(+", "(0", "(1", "(2", "(3", "(4", "(5", "(6", "(7", "(8", "(9")]
_ID_CUES = ["SSN", "S.S.N.", "ITIN", "D.L.", "NINO", "DNI", "NIE", "NIF", "NIR", "N.I.R"] + [w for x in ("social sec", "soc. sec", "soc.sec", "taxpayer", "passport", "driver", "national ins", "national id", "aadhaar", "steuer", "codice fiscale", "numéro de séc") for w in (x, x.upper(), x.capitalize(), x.title())]
_BEFORE_TAIL = re.compile(rf"(?<![\w.'\-])({_TITLE})?({_NAME})$")
#: Words that a name before a tail may have, titles and signs included.
_NAME_WORDS = 7
_GOES_ON_SMALL = re.compile(r"(?:,? [a-z]|[.,;:)]|$)")
_GIVEN_FIRST = re.compile(rf" (?:{_INITIAL} )*({_FAMILY})(?![\w])")
_GIVEN_LAST = re.compile(rf"(?<![\w.'\-])({_FAMILY}), $")
_INITIALED = re.compile(rf"(?<![\w.'\-])({_INITIAL} ?(?:{_INITIAL} ?)?)({_FAMILY})")
_FIRM = frozenset("Inc LLC L.L.C LLP LP Ltd Co Corp Trust Company Corporation Partners Partnership Group INC LTD CO CORP TRUST COMPANY GmbH PLC".split())
_STRUCTURE = frozenset(w for x in f"Building|Tower|Towers|Center|Centre|Plaza|Arcade|Galleria|Mall|Commons|House|Park|Works|Exchange|Market|Hall|Garage|garage|{_SUFFIX}".split("|") for w in (x, x.upper()))
_TRADE = frozenset(w for x in "Ventures Holdings Leasing Realty Retail Interiors Outfitters Properties Capital Asset Enterprises Associates Industries Services".split() for w in (x, x.upper()))
_PARTNER = re.compile(rf"(?:,? (?:Inc|LLC|LLP|LP|Ltd|INC|LTD)\b| (?:&|and|AND) {_WORD}(?:-{_WORD})? (?:LLP|LLC|LP|L\.L\.P))")
_NEXT = re.compile(rf",? ({_WORD}(?:-{_WORD})?|LLC|LP|LLP)(?![\w])")
_NO_PERSON = frozenset(
    "landlord tenant lessor lessee owner occupant subtenant sublandlord guarantor lease section article paragraph exhibit suite unit bay space building property accounts payable office department legal management manager operations the this each any all an one in on at by for from within upon subject notwithstanding except permit taxes parking common holdover percentage radius interest late access disputes reference drawing sheet title authorized signatory managing member january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday unknown vacant attorney counsel agent broker general if after before during beginning nothing subject within under each parties party storage emergency copies notices questions witness applicant attn name keys rent guarantor permit premises lessor hazardous radius no not when where while until unless".split()
)


# Common given names by gender, without those that are words of contracts too (Mark, Bill, Grace, Rose).
FEMALE = frozenset(
    """anna maria mary margaret elizabeth jennifer linda barbara susan jessica sarah karen nancy lisa betty sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca laura
    cynthia kathleen amy angela shirley brenda pamela nicole samantha katherine christine helen rachel carolyn janet catherine julia sophia isabella olivia emma sophie charlotte claire marie isabelle ingrid
    elena olga natalia svetlana tatiana irina fatima aisha priya lakshmi sunita mei yuki""".split()
)
MALE = frozenset(
    """james robert john michael david william richard joseph thomas christopher charles daniel matthew anthony steven andrew paul joshua kenneth kevin brian george timothy ronald jason edward jeffrey ryan jacob
    gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory alexander patrick peter henry douglas pierre jean hans klaus carlos miguel juan luis sergei dmitri ivan vladimir nikolai
    mohammed ahmed ali omar raj amit rahul wei hiroshi kenji""".split()
)
_HE = re.compile(r"(?:\b(?:Mr|MR|Herr|Hr|Sr|Monsieur|M)\.? ?|\b(?:Mister|Sir|Señor) |г-н |[Гг]осподин |श्री )$")
_SHE = re.compile(r"(?:\b(?:Mrs|Ms|MRS|MS|Mme|Mlle|Fr|Sra|Srta)\.? ?|\b(?:Miss|Madam|Dame|Frau|Madame|Señora) |г-жа |[Гг]оспожа |श्रीमती )$")

_CYR = "[А-ЯЁ][а-яё]+"
#: Names of other scripts, each with its own cues: (script that must occur, pattern with the name as group 1).
_SCRIPTS = [
    (re.compile("[Ѐ-ӿ]"), re.compile(rf"(?:г-н|г-жа|[Гг]осподин|[Гг]оспожа|[Мм]еня зовут|Арендатор:|Подпись:|Подписал:|[Кк]онтакт(?:ное лицо)?:|Имя:|Вниманию:?|Attn:)\s+({_CYR}(?:-{_CYR})?(?:\s{_CYR}){{0,2}}|(?:[А-ЯЁ]\.\s?){{1,2}}{_CYR})")),
    (re.compile("[Ѐ-ӿ]"), re.compile(rf"(?<![\w.])((?:{_CYR} )?{_CYR} [А-ЯЁ][а-яё]+(?:вич|вна|ична)(?: {_CYR})?)(?!\w)")),
    (re.compile("[\u3040-\u9fff]"), re.compile("(?:收件人|联系人|聯絡人|姓名|签字人|签署人|担当者|氏名|署名|Attn|ATTN|Attention|宛先)[:：] ?([\u4e00-\u9fff]{2,4})(?![\u4e00-\u9fff])")),
    (re.compile("[\u3040-\u9fff]"), re.compile("(?<![\u4e00-\u9fff])([\u4e00-\u9fff]{2,4}?)(?=先生|女士|小姐|様|さん)")),
    (re.compile("[가-힣]"), re.compile("(?:담당자|수신|성명)[:：] ?([가-힣]{2,4})(?![가-힣])")),
    (re.compile("[가-힣]"), re.compile("(?<![가-힣])([가-힣]{2,4})(?= ?(?:씨|님)(?![가-힣]))")),
    (re.compile("[\u0600-\u06ff]"), re.compile("(?:السيدة|السيد|الاسم:|إلى:)\\s+([\u0621-\u064a]{2,}(?:\\s[\u0621-\u064a]{2,}){0,2}?)(?=[\\s،.,؛]|$)")),
    (re.compile("[\u0900-\u097f]"), re.compile("(?:श्रीमती|श्री|नाम:)\\s+([\u0900-\u097f]{2,}(?:\\s[\u0900-\u097f]{2,})?)(?=[\\s,।]|$)")),
]
_NATIONAL_PHONE = re.compile(r"(?<![\w\-.,/+$#(])(?:\(0\d{2,4}\) ?\d{3,4}[ \-]\d{3,4}|0\d{2,4}[ \-/]\d{3,4}[ \-]\d{3,4}|0\d(?:[ .]\d\d){4})(?![\w\-])")
_PROPER = r"(?:[A-ZÀ-Þ][\w'\-]+)(?: [A-ZÀ-Þ][\w'\-]+){0,2}"
#: Addresses of other countries: signs one of which must occur, and the pattern.
_EUROPE = [
    ((" rue ", " avenue ", " boulevard ", " allée ", " chemin ", " quai ", " impasse "), re.compile(rf"(?<![\w\-.,$/#+])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|allée|chemin|quai|impasse)(?: (?:de la|de l'|du|des|de|d'|la|le|les))? ?{_PROPER}")),
    (("straße ", "strasse ", "str. ", "weg ", "platz ", "allee ", "gasse ", "damm ", "ufer "), re.compile(r"(?<!\w)[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|platz|allee|gasse|damm|ufer) \d{1,4} ?[a-z]?(?!\w)")),
    (("Calle ", "Avenida ", "Paseo ", "Via ", "Viale ", "Piazza ", "Corso ", "Rua "), re.compile(rf"(?<!\w)(?:Calle|Avenida|Paseo|Via|Viale|Piazza|Corso|Rua)(?: (?:de la|de los|del|de|da|do|di|della))? {_PROPER},? (?:n[.º°]+ ?)?\d{{1,4}}(?!\w)")),
]
_MORE_ID = re.compile(
    r"\b(?:national insurance(?: (?:number|no\.?))?|NINO|Aadhaar(?: (?:number|no\.?))?|DNI|NIE|NIF|Steuer-?ID(?:nummer)?|Steueridentifikationsnummer|codice fiscale|numéro de sécurité sociale|N\.?I\.?R\.?|national id(?:entity)?(?: (?:card|number|no\.?))*)"
    r"\s?(?:is\s)?[:#]?\s?((?=[A-Z0-9\- .]*\d)[A-Z0-9](?:[ .\-]?[A-Z0-9]){6,20})(?![\w])", re.I
)


def _verhoeff(digits: str) -> bool:
    """Whether the last digit checks the others (dihedral group of order 10)."""
    def times(a: int, b: int) -> int:
        return (a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5
    turn = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        for _ in range(i % 8):
            d = turn[d]
        total = times(total, d)
    return total == 0


def national_id(value: str) -> bool:
    """Whether a number behind a national cue has a known form, with its check digit where there is one."""
    bare = re.sub(r"[ .\-]", "", value).upper()
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", bare):
        return True
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", bare):
        number = int({"X": "0", "Y": "1", "Z": "2"}.get(bare[0], bare[0]) + bare[1:-1])
        return "TRWAGMYFPDXBNJZSQVHLCKE"[number % 23] == bare[-1]
    if re.fullmatch(r"\d{12}", bare):
        return _verhoeff(bare)
    if re.fullmatch(r"\d{11}", bare):
        p = 10
        for c in bare[:-1]:
            n = (int(c) + p) % 10 or 10
            p = n * 2 % 11
        return (11 - p) % 10 == int(bare[-1])
    if re.fullmatch(r"[12]\d{14}", bare):
        return 97 - int(bare[:13]) % 97 == int(bare[13:])
    return re.fullmatch(r"[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]", bare) is not None


def _machine(words: list[tuple[str, str]]):
    """Finds all of the words at once: (start, end, sort) of each place."""
    try:
        import ahocorasick
    except ImportError:
        ahocorasick = None
    sorts = {w: k for w, k in words}
    if ahocorasick is None:
        pattern = re.compile("(?=(" + "|".join(re.escape(w) for w in sorted(sorts, key=len, reverse=True)) + "))")
        shorter = {w: [v for v in sorts if w.startswith(v)] for w in sorts}
        return lambda text: sorted(((m.start(), m.start() + len(w), sorts[w]) for m in pattern.finditer(text) for w in shorter[m[1]]), key=lambda h: (h[1], h[0]))
    found = ahocorasick.Automaton()
    for w, k in sorts.items():
        found.add_word(w, (len(w), k))
    found.make_automaton()
    return lambda text: sorted(((end + 1 - n, end + 1, k) for end, (n, k) in found.iter(text)), key=lambda h: (h[1], h[0]))


class NameForms:
    """Known tokens, and the word parts that known family names share."""

    def __init__(self, tokens: Iterable[tuple[str | None, str | None]]):
        tokens = [(t.strip().lower(), k) for t, k in tokens if t and t.strip()]
        self.given = frozenset(t for t, k in tokens if k == "given")
        self.family = frozenset(t for t, k in tokens if k == "family")
        heads: Counter[str] = Counter()
        tails: Counter[str] = Counter()
        for t in self.family:
            for i in range(3, len(t) - 2):
                heads[t[:i]] += 1
                tails[t[i:]] += 1
        least = max(3, len(self.family) // 60)
        self.heads = frozenset(h for h, n in heads.items() if n >= least)
        self.tails = frozenset(h for h, n in tails.items() if n >= least)
        self.machine = _machine(
            [(c, "cue") for c in _CUES] + [(c, "title") for c in _TITLES] + [(c, "tail") for c in _TAILS] + [(c, "id") for c in _ID_CUES] + [(w, "given") for n in self.given for w in (n.title(), n.upper())] + [(w, "common") for n in (FEMALE | MALE) - self.given for w in (n.title(), n.upper())]
        )
        self._seen: dict[str, bool] = {}

    def family_like(self, word: str) -> bool:
        known = self._seen.get(word)
        if known is None:
            known = any(self._one(p) for p in word.lower().split("-"))
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[word] = known
        return known

    def _one(self, word: str) -> bool:
        for prefix in ("o'", "d'", "mc", "mac", ""):
            if word.startswith(prefix):
                rest = word[len(prefix) :]
                if rest in self.family or any(rest[:i] in self.heads and rest[i:] in self.tails for i in range(3, len(rest) - 2)):
                    return True
        return False

    def person(self, name: str, cued: bool) -> bool:
        words = [w for w in re.split(r"[ ,]+", name) if w and not (len(w) <= 2 and w.endswith("."))]
        if not words or any(w.lower() in _NO_PERSON for w in words):
            return False
        known = any(self.family_like(w) for w in words) or any(w.lower() in self.given for w in words)
        return known or (cued and (len(words) > 1 or name != words[0]))


def _trimmed(name: str, forms: NameForms) -> str:
    """Without a capital word behind the family name that belongs to what follows."""
    words = name.split(" ")
    if len(words) > 1 and "," not in name and (words[-1].lower() in _NO_PERSON or (len(words) == 2 and not words[0].endswith(".") and forms.family_like(words[0]) and not forms.family_like(words[1]))):
        return " ".join(words[:-1])
    return name


def _goes_on(text: str, end: int, forms: NameForms) -> bool:
    """Whether the name goes on as that of a firm, building or street."""
    if _PARTNER.match(text, end):
        return True
    at = end + 2 if text.startswith("'s", end) else end
    for step in range(4):
        m = _NEXT.match(text, at)
        if m is None or (step == 0 and text[at] == ","):
            return False
        word = m[1]
        if word in _FIRM or (step == 0 and (word in _STRUCTURE or word in _TRADE)):
            return True
        if word.lower() in _NO_PERSON or word.lower() in forms.given or forms.family_like(word):
            return False
        at = m.end()
    return False


def find(text: str, forms: NameForms) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all entities, in order and without overlap."""
    plain = text if text.isascii() else text.translate(_WIDE)
    taken: list[tuple[int, int, str]] = []

    def free(start: int, end: int) -> bool:
        """Spans never overlap, so only the neighbours can meet a new one."""
        i = bisect_left(taken, (start,))
        return (i == len(taken) or end <= taken[i][0]) and (i == 0 or taken[i - 1][1] <= start)

    def take(start: int, end: int, kind: str) -> None:
        insort(taken, (start, end, kind))

    # Whatever _MARK takes holds one of these.
    small = plain.lower()
    if any(x in small for x in ("@", "at)", "at ]", "at )", "at]", " dot ")):
        for m in _MARK.finditer(plain):
            domain = _DOMAIN.match(plain, m.end())
            if not domain:
                continue
            stop = low = m.start() - (m.start() > 0 and plain[m.start() - 1].isspace())
            while low and (plain[low - 1] in _LOCAL_SIGNS or (plain[low - 1].isascii() and plain[low - 1].isalnum())):
                low -= 1
            local = _LOCAL.search(plain[low : m.start()]) if low < stop else None
            if local and free(low + local.start(), domain.end(1)):
                take(low + local.start(), domain.end(1), "email")
    hits = forms.machine(plain)
    for start, _, sort in hits:
        if sort == "id" and not (start and plain[start - 1].isalnum()):
            m = _ID.match(plain, start) or _MORE_ID.match(plain, start)
            if m and m.re is _MORE_ID and not national_id(m[1]):
                continue
            if m and free(m.start(1), m.end(1)):
                take(m.start(1), m.end(1), "id_number")
    for m in _PHONE.finditer(plain):
        if free(m.start(), m.end()) and not _NO_PHONE.search(plain, max(0, m.start() - 40), m.start()):
            take(m.start(), m.end(), "phone")
    for m in _NATIONAL_PHONE.finditer(plain) if " 0" in plain or "(0" in plain or "\n0" in plain or plain[:1] == "0" else ():
        if free(m.start(), m.end()) and not _NO_PHONE.search(plain, max(0, m.start() - 40), m.start()):
            take(m.start(), m.end(), "phone")
    for signs, pattern in _EUROPE:
        if any(x in plain for x in signs):
            for m in pattern.finditer(plain):
                if free(m.start(), m.end()):
                    take(m.start(), m.end(), "address")
    for m in _ADDRESS.finditer(plain):
        if free(m.start(), m.end()) and not _NO_HOUSE.search(plain, max(0, m.start() - 14), m.start()):
            take(m.start(), m.end(), "address")

    def name(start: int, found: str, cued: bool, trim: bool = True) -> bool:
        found = _trimmed(found, forms) if trim else found
        end = start + len(found)
        if not forms.person(found, cued) or not free(start, end) or _goes_on(plain, end, forms):
            return False
        take(start, end, "name")
        return True

    cued, last = [], -1
    for start, end, sort in hits:
        inner = bool(start) and (plain[start - 1].isalnum() or plain[start - 1] in "_'-") and plain[start].isalnum()
        if sort == "cue" and not inner and end != last:
            last = end
            m = _CUED.match(plain, end)
            if not m or (not m[1] and " " not in m[2]):
                continue
            at = m.start(2)
            found = m[2].split(",")[0] if m[1] else m[2]
            if not name(at, found, True, trim=m[1] is not None) and "," in found:
                continue
            after = _AND.match(plain, at + len(found))
            if after and (after[1] or " " in after[2]):
                name(after.start(2), after[2].split(",")[0] if after[1] else after[2], True, trim=after[1] is not None)
        elif sort == "title" and not inner:
            m = _TITLED.match(plain, end)
            if m:
                name(m.start(1), m[1], True)
        elif sort in ("tail", "given", "common"):
            cued.append((start, end, sort, inner))
    for start, end, sort, inner in cued:
        if sort == "tail":
            low = start
            for _ in range(_NAME_WORDS):
                low = max(0, plain.rfind(" ", 0, max(0, low - 1)) + 1)
            before = _BEFORE_TAIL.search(plain[low:start])
            if before:
                name(low + before.start(2), before[2], "(" not in plain[start:end], trim=False)
        elif sort == "common":
            # A common given name and a capital word that the sentence goes on behind in small letters.
            m = _GIVEN_FIRST.match(plain, end)
            if not inner and m and m[1][1:].islower() and _GOES_ON_SMALL.match(plain, m.end()) and m[1] not in _STRUCTURE and m[1] not in _FIRM and not m[1].lower() in _NO_PERSON:
                name(start, plain[start : m.end()], True, trim=False)
        elif not inner:
            m = _GIVEN_FIRST.match(plain, end)
            if m and forms.family_like(m[1]):
                name(start, plain[start : m.end()], False, trim=False)
            elif not plain[end : end + 1].isalpha():
                low = max(0, plain.rfind(" ", 0, max(0, start - 2)) + 1)
                before = _GIVEN_LAST.search(plain[low:start])
                if before and forms.family_like(before[1]):
                    name(low + before.start(1), before[0] + plain[start:end], False, trim=False)
    for m in _INITIALED.finditer(plain):
        before = plain[max(0, m.start() - 12) : m.start()]
        if forms.family_like(m[2]) and not re.search(r"(?:Exhibit|EXHIBIT|Annex|Schedule|Art|Section|&|\d) ?$", before):
            name(m.start(), m[0], False, trim=False)
    if not plain.isascii():
        for script, pattern in _SCRIPTS:
            if script.search(plain):
                for m in pattern.finditer(plain):
                    if free(m.start(1), m.end(1)):
                        take(m.start(1), m.end(1), "name")
    return taken


_SYLLABLES = [a + v for a in "b d f g h j k l m n p r s t v z br dr st tr".split() for v in "aeiou"]
_CODAS, _ENDS = ("", "l", "n", "r"), ("l", "n", "r", "s")
# How the letters of syllables are written in Cyrillic, and letters of given names in other scripts.
_CYRILLIC = dict(zip("abdefghijklmnoprstuvz", "абдефгхиджклмнопрстувз".replace("дж", "й"), strict=True))
_STOCKS = {
    "han": "明华建国志强伟军勇杰涛超辉刚平鹏飞文斌波宁林峰晨浩宇轩嘉怡雪梅兰芳静丽敏燕玲秀英红霞琳慧佳欣悦诗涵梓萱若彤",
    "hangul": "민서준우현지수영진호성재훈태경은혜정윤아연주하나미선희숙동건원석철기상용",
    "arabic": "بتثجحخدرزسشصطعفقكلمنهوي",
    "devanagari": "कखगचजटडतदनपबमयरलवशसह",
}
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7))
_TAIL = re.compile(rf"\s(?:{_SUFFIX})\b\.?$", re.I)
_AT = re.compile(r"\s?(?:@|[\[(] ?at ?[\])])| at ", re.I)
_EXT = re.compile(r",? ?(?:ext|x)", re.I)
_NARROW = {v: k for k, v in _WIDE.items() if 0xFF01 <= k <= 0xFF5E}
#: Attempts of a phone number that keep its area code; later ones draw it anew, should most of the area's numbers be taken.
AREA_ATTEMPTS = 16


def _draw(key: bytes, *what: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x00".join(map(str, what)).encode(), "sha256"), "big")


def _permuted(key: bytes, tweak: str, text: str) -> str:
    """A keyed permutation of the texts of one shape: digits stay digits, small letters stay small letters."""
    radix = [10 if c.isdigit() else 26 for c in text]
    value = [int(c) if c.isdigit() else ord(c) - 97 for c in text]
    middle = len(text) // 2
    halves, sizes = [0, 0], [1, 1]
    for i, (v, r) in enumerate(zip(value, radix, strict=True)):
        halves[i >= middle] = halves[i >= middle] * r + v
        sizes[i >= middle] *= r
    shape = "".join("9" if r == 10 else "a" for r in radix)
    for turn in range(8):
        side = turn % 2
        halves[side] = (halves[side] + _draw(key, tweak, shape, turn, halves[1 - side])) % sizes[side]
    out = []
    for i in reversed(range(len(text))):
        halves[i >= middle], v = divmod(halves[i >= middle], radix[i])
        out.append(str(v) if radix[i] == 10 else chr(97 + v))
    return "".join(reversed(out))


def script(word: str) -> str:
    """'latin', 'cyrillic', 'han', 'hangul', 'arabic' or 'devanagari' by the first letter."""
    c = word[:1]
    bounds = (("cyrillic", "\u0400", "\u052f"), ("arabic", "\u0600", "\u06ff"), ("devanagari", "\u0900", "\u097f"), ("han", "\u3040", "\u9fff"), ("hangul", "\uac00", "\ud7a3"))
    return next((name for name, low, high in bounds if low <= c <= high), "latin")


def usual_gender(word: str) -> str:
    """'f' or 'm' of a common given name, in small letters; '' of others."""
    return "f" if word in FEMALE else "m" if word in MALE else ""


def _word(key: bytes, sort: str, value: str, attempt: int, a: bool) -> str:
    """A word of three syllables and one more for each attempt, so the words never run out; it ends in -a if asked to.

    Words of other scripts are drawn from letters of the script, as many as the value
    has and one more for each two attempts.
    """
    kind = script(value) if sort == "word" else "latin"
    if kind in _STOCKS:
        stock = _STOCKS[kind]
        return "".join(stock[_draw(key, sort, value, attempt, i) % len(stock)] for i in range(max(2, len(value)) + attempt // 2))
    out, n = [], 0
    for i in range(last := 2 + attempt):
        n = n if n >= 400 else _draw(key, sort, value, attempt, i)
        n, k = divmod(n, 400)
        out.append(_SYLLABLES[k // 4] + _CODAS[k % 4])
    k = _draw(key, sort, value, attempt, last) % 400
    out.append(_SYLLABLES[k // 4][:-1] + "a" if a else _SYLLABLES[k // 4] + _ENDS[k % 4])
    found = "".join(out)
    return "".join(_CYRILLIC[c] for c in found) if kind == "cyrillic" else found


def canonical(kind: str, value: str) -> str:
    """What two mentions of one entity have in common."""
    value = value.translate(_WIDE).lower()
    if kind in ("phone", "id_number") and not value.isascii():
        value = "".join(str(int(c)) if c.isdecimal() else c for c in value)
    if kind == "phone":
        digits = re.sub(r"\D", "", re.split(r",? ?(?:ext|x)", value)[0])
        return digits[-10:]
    if kind == "id_number":
        return re.sub(r"[^a-z0-9]", "", value)
    if kind == "email":
        return re.sub(r"\s", "", re.sub(r"\s?[\[(] ?dot ?[\])]\s?| dot ", ".", re.sub(r"\s?[\[(] ?at ?[\])]\s?| at ", "@", value)))
    if kind == "name" and ", " in value:
        family, given = value.split(", ", 1)
        value = f"{given} {family}"
    return re.sub(r"\s+", " ", value)


def _like(pattern: str, word: str) -> str:
    """The word in the letter case and width of the pattern."""
    plain = pattern.translate(_WIDE)
    word = word.upper() if plain.isupper() else word.title() if plain.lower() != plain else word
    return word.translate(_NARROW) if any(0xFF01 <= ord(c) <= 0xFF5E for c in pattern) else word


def units(kind: str, value: str) -> list[tuple[str, str]]:
    """(sort, unit) of what is replaced in a mention: the entity, or each word of a name, so that parts of names agree."""
    same = canonical(kind, value)
    if kind != "name":
        return [(kind, same)]
    return [("word", w) for w in re.findall(r"[^\W\d_](?:[^\W\d_]|[\u0900-\u0963])*", same) if len(w) > 1]


@lru_cache
def _initials(key: bytes, letters: str) -> dict[str, str]:
    """One keyed cycle through all letters, so none stands for itself."""
    order = sorted(letters, key=lambda c: _draw(key, "initial", c))
    return dict(zip(order, order[1:] + order[:1], strict=True))


@lru_cache(1 << 16)
def fresh_unit(key: bytes, sort: str, unit: str, attempt: int = 0, gender: str | None = None) -> str:
    """The surrogate of a unit, in canonical form.

    gender: of a word of a name ('f', 'm' or '' where unknown); None is the usual one.
    Numbers are permuted, so one attempt never joins two of them; words may meet,
    which ``attempts_over`` settles.
    """
    if sort == "phone":
        head = unit[:-7] if attempt < AREA_ATTEMPTS else ""
        return head + _permuted(key, f"phone {head} {attempt}", unit[len(head) :])
    if sort == "id_number":
        return _permuted(key, f"id_number {attempt}", unit)
    if sort == "email":
        local, domain = unit.rsplit("@", 1)
        return f"{_word(key, 'mailbox', unit, attempt, True)}.{_word(key, sort, unit, attempt, False)}@{domain}"
    if sort == "address":
        tail, n = _TAIL.search(unit), _draw(key, "house", unit, attempt)
        house = str(n % 8999 + 100) if unit[0].isdigit() else _NUMBER.lower().split("|")[n % 20]
        return f"{house} {_word(key, sort, unit, attempt, False)}{tail[0] if tail else ' street'}"
    gender = usual_gender(unit) if gender is None else gender
    return _word(key, sort, unit, attempt, gender == "f" or (not gender and unit.endswith(("a", "а"))))


def surrogate(key: bytes, kind: str, value: str, attempts: Mapping[tuple[str, str], int], genders: Mapping[str, str] | None = None) -> str:
    """A replacement of the same kind and shape.

    attempts has the units that are not at their first one, genders the words of names
    whose gender is not the usual one.
    """
    genders = genders or {}
    plain = value.translate(_WIDE)
    if kind == "name":

        def part(m: re.Match[str]) -> str:
            old = value[m.start() : m.end()]
            if len(m[0]) > 1:
                word = m[0].lower()
                return _like(old, fresh_unit(key, "word", word, attempts.get(("word", word), 0), genders.get(word)))
            letters = next((x for x in _LETTERS if m[0] in x), "")
            if not letters or plain[m.end() : m.end() + 1] != ".":
                return old
            return _like(old, _initials(key, letters)[m[0]].lower())

        out, at = [], 0
        for m in re.finditer(r"[^\W\d_](?:[^\W\d_]|[\u0900-\u0963])*", plain):
            out += [value[at : m.start()], part(m)]
            at = m.end()
        return "".join([*out, value[at:]])
    [unit] = units(kind, value)
    fresh = fresh_unit(key, *unit, attempts.get(unit, 0))
    if kind == "email":
        local = value[: _AT.search(plain).start()]
        return _like(local, fresh.rsplit("@", 1)[0]) + value[len(local) :]
    if kind == "address":
        tail = _TAIL.search(plain)
        house, street = fresh.split(" ")[:2]
        head = value[: tail.start()] if tail else value
        return _like(head, f"{house} {street}") + (value[tail.start() :] if tail else " Street")
    # Characters of the unit, in order; an extension is drawn for itself.
    marks = [i for i, c in enumerate(plain) if c.isdecimal() or (kind == "id_number" and "a" <= c.lower() <= "z")]
    if kind == "phone":
        ext = _EXT.search(plain)
        more = [i for i in marks if ext and i >= ext.end()]
        marks = [i for i in marks if i not in more][-len(unit[1]) :]
        marks, fresh = marks + more, fresh + _permuted(key, f"extension {unit[1]}", "".join(str(int(plain[i])) for i in more))
    out = list(value)
    for i, c in zip(marks, fresh, strict=True):
        out[i] = chr(ord(value[i]) - int(value[i]) + int(c)) if value[i].isdecimal() else _like(value[i], c)
    return "".join(out)


def attempts_in(key: bytes, found: Iterable[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """``attempts_over`` for the units of one text."""
    state = dict.fromkeys(sorted(set(found)), 0)
    while True:
        taken: set[tuple[str, str]] = set()
        bad = []
        for unit in sorted(state, key=lambda u: (state[u], u)):
            fresh = (unit[0], fresh_unit(key, *unit, state[unit]))
            if fresh in state or fresh in taken:
                bad.append(unit)
            taken.add(fresh)
        if not bad:
            return {u: n for u, n in state.items() if n}
        for unit in bad:
            state[unit] += 1


def attempts_over(found: DataFrame, key: bytes) -> DataFrame:
    """``sort, unit, gender, attempt`` of the units not at their first attempt or of an unusual gender.

    found: distinct ``sort, unit, gender`` of the corpus (gender null is the usual one).
    No two units have one surrogate and none is a unit of the corpus: whoever meets an
    original, or a unit that settled before (else the lesser one), goes on to its next
    attempt, until none does.
    """
    shapes = found.filter("sort = 'id_number'").groupBy(F.regexp_replace(F.regexp_replace("unit", "[a-z]", "a"), "[0-9]", "9").alias("shape")).count()
    space = F.pow(F.lit(10.0), F.length(F.regexp_replace("shape", "a", ""))) * F.pow(F.lit(26.0), F.length(F.regexp_replace("shape", "9", "")))
    full = shapes.filter(F.col("count") * 4 > space).first()
    if full is not None:
        raise ValueError(f"{full['count']} distinct id numbers of the shape {full['shape']} leave too few others for surrogates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fresh = [fresh_unit(key, sort, unit, attempt, gender) for sort, unit, gender, attempt in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fresh, pa.string())], names=["sort", "unit", "gender", "attempt", "fresh"])

    state = found.withColumn("attempt", F.lit(0))
    first = W.partitionBy("sort", "fresh").orderBy("attempt", "unit")
    while True:
        drawn = state.mapInArrow(run, "sort string, unit string, gender string, attempt int, fresh string")
        originals = found.select("sort", F.col("unit").alias("fresh"), F.lit(True).alias("original"))
        state = cut(
            drawn.withColumn("later", F.row_number().over(first) > 1)
            .join(originals, ["sort", "fresh"], "left")
            .withColumn("bad", F.col("later") | F.col("original").isNotNull())
            .select("sort", "unit", "gender", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"), "bad")
        )
        if not state.filter("bad").limit(1).count():
            return state.filter("attempt > 0 or gender is not null").select("sort", "unit", "gender", "attempt")
        state = state.drop("bad")


def replace(text: str, spans: list[tuple[int, int, str]], key: bytes | None, attempts: Mapping[tuple[str, str], int] | None = None) -> str:
    """Placeholders (no key) or surrogates; mentions of one entity are replaced alike.

    attempts: those of the corpus; without them the text is a corpus of its own.
    """
    given: dict[tuple[str, str], str] = {}
    numbers: Counter[str] = Counter()
    if key is not None and attempts is None:
        attempts = attempts_in(key, (u for a, b, kind in spans for u in units(kind, text[a:b])))
    out, at = [], 0
    for a, b, kind in spans:
        value = text[a:b]
        if key is None:
            same = (kind, canonical(kind, value))
            if same not in given:
                numbers[kind] += 1
                given[same] = f"[{kind.upper()}_{numbers[kind]}]"
            fresh = given[same]
        else:
            fresh = surrogate(key, kind, value, attempts)
        out += [text[at:a], fresh]
        at = b
    return "".join([*out, text[at:]])


def name_forms(names: DataFrame) -> NameForms:
    rows = names.select("token", "kind").filter("token is not null").distinct().limit(NAME_LIST_MOST + 1).collect()
    if len(rows) > NAME_LIST_MOST:
        raise ValueError(f"the name list has over {NAME_LIST_MOST} tokens")
    return NameForms((r.token, r.kind) for r in rows)


def _rows(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(F.col(id_column).cast("string").alias("document_id"), F.col(text_column).alias("text")).filter("document_id is not null")


def _vote(text: str, start: int, value: str) -> tuple[str | None, int]:
    """The given name of a full name behind a title, and what the title says: 1 of a woman, -1 of a man, 0 nothing."""
    words = [w for _, w in units("name", value)]
    before = text[max(0, start - 12) : start]
    if len(words) < 2 or not before:
        return None, 0
    return words[0], 1 if _SHE.search(before) else -1 if _HE.search(before) else 0


def mentions(documents: DataFrame, names: DataFrame, id_column: str = "document_id", text_column: str = "normalized_text") -> DataFrame:
    """``document_id, text_hash, kind, start_char, end_char, value, given, vote`` of every occurrence, each row of the table read once."""
    forms = name_forms(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, starts, ends, values, given, votes = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for a, b, kind in find(text, forms):
                    who, vote = _vote(text, a, text[a:b]) if kind == "name" else (None, 0)
                    rows.append(i)
                    kinds.append(kind)
                    starts.append(a)
                    ends.append(b)
                    values.append(text[a:b])
                    given.append(who)
                    votes.append(vote)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.string()), pa.array(given, pa.string()), pa.array(votes, pa.int32())],
                names=["document_id", "text_hash", "kind", "start_char", "end_char", "value", "given", "vote"],
            )

    rows = _rows(documents, id_column, text_column).filter("text is not null").select("document_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "document_id string, text_hash long, kind string, start_char int, end_char int, value string, given string, vote int").distinct()


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """``kind, value, surrogate`` of every distinct value of the mentions: one table for the whole corpus."""
    secret = key.encode()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, v, *u) for k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True) for u in units(k, v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["kind", "value", "sort", "unit"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fresh = []
            for kind, value, moved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                moved = moved or ()
                fresh.append(surrogate(secret, kind, value, {(m["sort"], m["unit"]): m["attempt"] for m in moved}, {m["unit"]: m["gender"] for m in moved if m["gender"] is not None}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fresh, pa.string())], names=["kind", "value", "surrogate"])

    values = found.select("kind", "value").distinct()
    parts = cut(values.mapInArrow(cut_up, "kind string, value string, sort string, unit string").distinct())
    usual = F.when(F.col("unit").isin(*FEMALE), "f").when(F.col("unit").isin(*MALE), "m").otherwise("")
    voted = found.filter("vote <> 0").groupBy(F.col("given").alias("unit")).agg(F.sum("vote").alias("vote")).filter("vote <> 0")
    genders = voted.select(F.lit("word").alias("sort"), "unit", F.when(F.col("vote") > 0, "f").otherwise("m").alias("gender")).filter(F.col("gender") != usual)
    moved = cut(attempts_over(cut(parts.select("sort", "unit").distinct().join(genders, ["sort", "unit"], "left")), secret))
    of_value = parts.join(moved, ["sort", "unit"]).groupBy("kind", "value").agg(F.collect_list(F.struct("sort", "unit", "gender", "attempt")).alias("moved"))
    return cut(values.join(of_value, ["kind", "value"], "left").select("kind", "value", "moved").mapInArrow(draw, "kind string, value string, surrogate string"))


def entities(documents: DataFrame, names: DataFrame, key: str, id_column: str = "document_id", text_column: str = "normalized_text") -> DataFrame:
    """``document_id, kind, start_char, end_char, surrogate`` of every occurrence, with what replaces it.

    Null and empty texts have none; an empty name list leaves cues and titles;
    repeated rows count once; rows with a null id are left out; whole texts are read.
    """
    found = cut(mentions(documents, names, id_column, text_column))
    return found.join(surrogates(found, key), ["kind", "value"]).select("document_id", "kind", "start_char", "end_char", "surrogate").distinct()


def redacted(documents: DataFrame, names: DataFrame, key: str | None = None, id_column: str = "document_id", text_column: str = "normalized_text") -> DataFrame:
    """``document_id, text, redaction_codes``: replaced text and the kinds found, in order of KINDS.

    Without key typed placeholders, with key surrogates.  A null text stays null
    and has no codes; repeated rows are kept once.
    """
    rows = _rows(documents, id_column, text_column)
    if key is not None:
        return _with_surrogates(documents, rows, names, key, id_column, text_column)
    forms = name_forms(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, codes = [], []
            for text in batch.column(1).to_pylist():
                spans = find(text, forms) if text else []
                texts.append(replace(text, spans, None) if spans else text)
                codes.append(_codes(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(codes, pa.list_(pa.string()))], names=["document_id", "text", "redaction_codes"])

    return rows.mapInArrow(run, "document_id string, text string, redaction_codes array<string>").distinct()


def _codes(spans: list[tuple[int, int, str]]) -> list[str]:
    kinds = {k for _, _, k in spans}
    return [k for k in KINDS if k in kinds]


def _with_surrogates(documents: DataFrame, rows: DataFrame, names: DataFrame, key: str, id_column: str, text_column: str) -> DataFrame:
    """Texts are found in once and joined once, to the spans of their own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, codes = [], []
            for text, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                out, at = [], 0
                for span in spans or ():
                    out += [text[at : span["start_char"]], span["surrogate"]]
                    at = span["end_char"]
                texts.append("".join([*out, text[at:]]) if spans else text)
                codes.append(_codes([(0, 0, span["kind"]) for span in spans or ()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(codes, pa.list_(pa.string()))], names=["document_id", "text", "redaction_codes"])

    found = cut(mentions(documents, names, id_column, text_column))
    fresh = found.join(surrogates(found, key), ["kind", "value"])
    spans = fresh.groupBy("document_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "kind", "surrogate"))).alias("spans"))
    ready = rows.withColumn("text_hash", F.xxhash64("text")).join(spans, ["document_id", "text_hash"], "left")
    return ready.select("document_id", "text", "spans").mapInArrow(run, "document_id string, text string, redaction_codes array<string>").distinct()
