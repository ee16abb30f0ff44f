"""Sentence units of texts in many languages and scripts.

Candidates are the closing marks of all scripts and the ends of quotations and brackets
that close behind a mark.  What no mark can end is no candidate: places inside a pair
of brackets or quotation marks, and places before a small letter, a comma or the like.
Every candidate is classified by one maximum-entropy model over its mark and the
neighbouring tokens: how often the token before ends or goes on, how often the word
behind starts, case, length, digits, script, lists of abbreviations and labels.

The counts of tokens are taken over all documents, by a distributed aggregate; what is
kept of them are the tokens that make up at least ``RARE`` of all.  The weights are
fitted to convergence, with a penalty around zero, on reliable places of a bounded
sample: ends of paragraphs, exclamation and question marks before a start, plain words
before a common starter (boundaries); marks before small letters and commas, titles and
initials before names, short tokens before numbers (no boundaries).  Blank lines always
end a unit, and so does a Thai blank between Thai letters, by definition.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausemill.session import cut

#: Bound of the sample the weights are fitted on: documents of least hash of the id, and places of each label taken from it.
TRAINING_DOCUMENTS = 2000
#: Share of all counted places below which a token counts as unknown; so at most 1 / RARE tokens are held.
RARE = 2e-6
#: Longest token that is looked at; longer ones count as unknown words.
WORD = 64
PENALTY = 1.0

_BREAK = re.compile(r"\n[^\S\n]*\n\s*")
_STOPS = ".!?…。！？｡।॥؟۔‼⁇⁈⁉՞።"
_HARD = frozenset("!?。！？｡।॥؟۔‼⁇⁈⁉՞።")
#: Marks (but for points within numbers and names), quotation marks and brackets.
_TOKEN = re.compile(f"[{re.escape(_STOPS)}]++(?![0-9a-z])|[“”„«»「」『』()（）\\[\\]\"【】]")
_MARKS = re.compile(f"[{re.escape(_STOPS)}]++(?![0-9a-z])")
_QUOTED = re.compile("[“”„«»「」『』()（）\\[\\]\"【】]")
_PAIRS = {"„": "“”", "«": "»", "“": "”“", "「": "」", "『": "』", "(": ")", "（": "）)", "[": "]", "【": "】", '"': '"'}
_CLOSERS = frozenset("”»」』)）]】\"’'“")
_BRACKETS = frozenset("(（[【")
_OPENED = re.compile(r"[(\[\"“„«「（]([^(\[\"“„«「（]*)$")
_WORD_AFTER = re.compile(r"[\"'“„«「（(\[¿¡\s]*([^\s.,;:!?)\]\"»”。，]{1,64})")
_THAI_GAP = re.compile(r"(?<=[฀-๿\"”)\]])[^\S\n]+(?=[฀-๿\"“(\[])")
_THAI = re.compile("[฀-๿]")
_SPEECH = re.compile(
    r"\s*(?:(?:[^\W\d_][\w'.\-]*\s+){0,4}?)(?:asked|said|says|replied|wrote|answered|added|stated|declared|explained|noted|continued|inquired|fragte|sagte|schrieb|demanda|demande|dit|répondit|écrivit|preguntó|dijo|respondió|escribió|спросила?|сказала?)\b"
)

# Abbreviations that are followed by what they belong to, by language.
NEVER_FINAL = frozenset(
    """mr mrs ms mx dr prof rev hon messrs st mt ft no nos vol vols pp p art arts sec secs ch fig figs ex cf viz vs v approx e.g i.e rev ed eds bldg dept gen col capt lt sgt
    hr fr dipl ing nr abs gem vgl bzw ca z.b d.h s.o s.u i.d.r u.a str tel inkl zzgl evtl ggf lfd
    m mme mlle mm mgr bd av env p.ex v.
    sr sra srta dra dña d. núm pág págs p.ej aprox esq ej c.v ctra
    г ул д корп стр рис см п пп кв т.е тел им проф
    डॉ प्रो रु मी श्री""".split()
)
# Abbreviations that may close a sentence.
MAYBE_FINAL = frozenset("etc inc corp co ltd llc u.s u.k e.u p.m a.m jr sr bros al ff usw ag gmbh s.a s.l s.r.l cie cía hnos т.д т.п руб коп mo ft yd".split())
_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
_FOLLOWERS = frozenset("KG Inc LLC LLP LP Ltd Corp Co Dept Stock Stockwerk GmbH OHG".split())
_NUMBER = re.compile(r"[$€£¥]?\d[\d.,:/\-]*[%x]?")
_LABELS = frozenset("exhibit annex schedule appendix anlage anhang annexe anexo attachment rider unit suite bay space section part block lot type class grade phase".split())


NAMES = (
    "bias", "hard", "ellipsis", "ellipsis_start", "quote", "bracket", "alone", "quote_inside", "speech", "tight_caseless", "pair_start", "bracket_point", "bracket_caseless",
    "end", "cont", "never", "maybe", "initial", "label", "number", "number_long", "inner", "short", "plain", "caseless_before", "closed", "bare", "thai_before",
    "start", "start_plain", "start_short", "follower", "month", "digit", "digit_short", "opening", "caseless", "no_space", "no_space_inner", "no_space_proper", "no_space_plain",
)
_AT = {name: i for i, name in enumerate(NAMES)}
Vector = tuple[tuple[int, float], ...]


def _caseless(ch: str) -> bool:
    return ch.isalpha() and ch.lower() == ch.upper()


def _bare(token: str) -> str:
    """In small letters, without an article or the like joined by an apostrophe."""
    token = token.lower()
    return re.split("['’]", token)[-1] if "'" in token or "’" in token else token


def _key(token: str) -> str:
    token = _bare(token.strip("»”“\"')]}）’"))
    return "9" if token[-1:].isdigit() else token


def _before(text: str, at: int, least: int = 0) -> str:
    """The token before ``at`` (its last ``WORD`` signs)."""
    part = text[max(least, at - WORD) : at]
    if not part or part[-1].isspace():
        return ""
    part = part.rsplit(None, 1)[-1]
    m = _OPENED.search(part)
    return part if m is None else m[1]


def _after(text: str, at: int) -> str:
    """The word behind; of scripts without blanks the first two signs."""
    m = _WORD_AFTER.match(text, at)
    if m is None:
        return ""
    word = m[1]
    return "~" + word[:2] if "\u3040" <= word[0] <= "\u9fff" else word


def token_counts(text: str, left: dict[str, list[int]], right: dict[str, list[int]]) -> None:
    """Adds a text's tokens with a point (seen, at a paragraph's end, going on) and words behind marks (starting, behind any point)."""
    n = len(text)
    for m in _MARKS.finditer(text):
        mark, at, stop = m[0], m.start(), m.end()
        sign = text[stop : stop + 1]
        while sign in _CLOSERS and sign:
            stop += 1
            sign = text[stop : stop + 1]
        nxt = stop
        while sign.isspace():
            nxt += 1
            sign = text[nxt : nxt + 1]
        closes = nxt == n or (nxt - stop > 1 and _BREAK.search(text, stop, nxt) is not None)
        token, long = None, False
        if mark == ".":
            if nxt == stop and not closes:
                continue
            before = _before(text, at)
            token, long = _key(before), len(before) >= 4
            row = left.get(token)
            if row is None:
                row = left[token] = [0, 0, 0]
            row[0] += 1
            row[1] += closes
            row[2] += not closes and (sign.islower() or sign.isdigit() or sign in ",;")
        if nxt == n or sign.islower():
            continue
        word = _after(text, nxt)
        if not word:
            continue
        row = right.get(word)
        if row is None:
            row = right[word] = [0, 0]
        if closes or (mark[-1] in _HARD and stop == m.end()):
            row[0] += 1
        elif token is not None and stop == m.end():
            # Behind a long plain word or number the point is no abbreviation's or ordinal's.
            if (token == "9" and long) or (len(token) >= 5 and token.isalpha() and token not in NEVER_FINAL and token not in MAYBE_FINAL):
                row[0] += 1
            elif token not in NEVER_FINAL and len(token.replace(".", "")) > 1 or token == "9":
                row[1] += 1


class Model:
    """Token counts and weights."""

    def __init__(self, left: dict[str, list[int]], right: dict[str, list[int]]):
        self.left, self.right = left, right
        seen, ended = (sum(r[i] for r in left.values()) for i in (0, 1))
        self.usual = math.log(max(1, ended) / max(2, seen))
        self.weights = np.zeros(len(NAMES))
        self._scores: dict[tuple, float] = {}
        self._rights: dict[str, Vector] = {}

    def start(self, word: str) -> float:
        """Log odds that a word behind a mark starts a sentence, between -2 and 2; 0 where it is unknown."""
        row = self.right.get(word)
        return 0.0 if row is None else max(-2.0, min(2.0, math.log((row[0] + 0.5) / (0.25 * row[1] + 0.5))))

    def _left(self, before: str, prior: str) -> Vector:
        """Features of the token with the point."""
        bare, key = _bare(before), _key(before)
        number = _NUMBER.fullmatch(before) is not None
        letters = "9" if number else before.replace(".", "")
        year = bare == "г" and prior[-1:].isdigit()
        maybe = bare in MAYBE_FINAL or year or (bare in ("д", "п") and prior == "т.")
        never = bare in NEVER_FINAL and not year and not (bare in ("д", "п") and maybe)
        label = prior.lower().strip("(,;:") in _LABELS
        seen, ended, cont = self.left.get(key, (0, 0, 0))
        out = []
        if not maybe or never:
            out.append(("end", max(-5.0, min(1.5, math.log((ended + 2 * math.exp(self.usual)) / (seen + 2)) - self.usual))))
            out.append(("cont", math.log((cont + 0.1) / (seen + 2)) - math.log(0.05)))
        plain = len(letters) >= (3 if letters and _caseless(letters[0]) else 4) and letters.isalpha() and not maybe and not never and cont * 10 <= seen
        out += [
            (name, 1.0)
            for name, there in (
                ("never", never), ("maybe", maybe), ("initial", len(letters) == 1 and letters.isalpha() and not label and not maybe), ("label", label), ("number", number and len(before) < 4), ("number_long", number and len(before) >= 4),
                ("inner", "." in before and not maybe and not number), ("short", len(letters) <= 3 and letters.isalpha() and not maybe), ("plain", plain),
                ("caseless_before", bool(letters) and _caseless(letters[0])), ("closed", before[-1:] in _CLOSERS and before != ""), ("bare", not before), ("thai_before", "\u0e00" <= before[-1:] <= "\u0e7f"),
            )
            if there
        ]
        return tuple((_AT[n], v) for n, v in out)

    def _right(self, word: str) -> Vector:
        found = self._rights.get(word)
        if found is None:
            out = [("start", self.start(word))]
            if word in _FOLLOWERS:
                out.append(("follower", 1.0))
            if word and _caseless(word.lstrip("~")[:1] or " "):
                out.append(("caseless", 1.0))
            found = tuple((_AT[n], v) for n, v in out)
            if len(self._rights) > 200_000:
                self._rights.clear()
            self._rights[word] = found
        return found

    def point(self, text: str, at: int, stop: int, nxt: int, least: int) -> tuple:
        """What decides about a point: (token, token before it, word behind, sign behind, space, a capital word behind)."""
        before = _before(text, at, least)
        prior = ""
        if len(before) <= 4 or before[-1:].isdigit():
            words = text[max(least, at - len(before) - WORD) : at - len(before)].rsplit(None, 1)
            prior = words[-1] if words else ""
        sign = text[nxt : nxt + 1]
        return (before, prior, _after(text, nxt) if sign else "", sign if sign in _PAIRS or sign.isdigit() else "", nxt > stop, sign.isupper() and text[nxt + 1 : nxt + 2].islower())

    def point_features(self, before: str, prior: str, word: str, sign: str, space: bool, proper: bool) -> Vector:
        left, right = self._left(before, prior), self._right(word)
        names = {i for i, _ in left}
        short = _AT["never"] in names or _AT["maybe"] in names or len(before) < 3
        out = [("bias", 1.0)]
        if _AT["never"] in names or _AT["initial"] in names:
            # What stands behind a title or an initial often starts sentences too.
            right = ((_AT["start_short"], self.start(word)), *right[1:])
        elif _AT["plain"] in names or _AT["number_long"] in names or _AT["label"] in names:
            right = ((_AT["start_plain"], max(0.0, self.start(word))), *right[1:])
        elif _AT["maybe"] in names or _AT["number"] in names:
            right = ((_AT["start"], max(-0.5, self.start(word))), *right[1:])
        if sign.isdigit():
            out.append(("digit", 1.0))
            if short:
                out.append(("digit_short", 1.0))
        elif sign:
            out.append(("opening", 1.0))
        if (_AT["number"] in names or _AT["number_long"] in names) and word.lower() in _MONTHS:
            out.append(("month", 1.0))
        if not space:
            out.append(("no_space", 1.0))
            if "." in before or "@" in before or "/" in before:
                out.append(("no_space_inner", 1.0))
            elif proper:
                out.append(("no_space_proper", 1.0))
            if _AT["plain"] in names or before[-1:].isdigit():
                out.append(("no_space_plain", 1.0))
        return tuple((_AT[n], v) for n, v in out) + left + right

    def mark_features(self, kind: str, word: str) -> Vector:
        """Features of an exclamation or question mark or an ellipsis."""
        if kind == "ellipsis":
            return ((0, 1.0), (_AT["ellipsis"], 1.0), (_AT["ellipsis_start"], self.start(word)))
        return ((0, 1.0), (_AT["hard"], 1.0))

    def pair_features(self, bracket: bool, alone: bool, pointed: bool, speech: bool, tight: bool, word: str) -> Vector:
        """Features of a quotation or bracket that closes behind a mark."""
        spoken = speech and alone and not bracket
        caseless = _caseless(word.lstrip("~")[:1] or " ")
        start = self.start(word) if caseless else max(0.0, self.start(word))
        out = [("bias", 1.0), ("bracket" if bracket else "quote", 1.0)] + ([] if spoken else [("pair_start", start)])
        for name, there in (
            ("alone", alone), ("quote_inside", not alone and not bracket), ("speech", spoken), ("tight_caseless", tight and alone and not bracket),
            ("bracket_point", bracket and not alone and pointed), ("bracket_caseless", bracket and not alone and caseless),
        ):
            if there:
                out.append((name, 1.0))
        return tuple((_AT[n], v) for n, v in out)

    def score(self, key: tuple, features) -> float:
        """The model's log odds; candidates that look alike are scored once."""
        found = self._scores.get(key)
        if found is None:
            w = self.weights
            found = sum(w[i] * v for i, v in features(*key[1:]))
            if len(self._scores) > 500_000:
                self._scores.clear()
            self._scores[key] = found
        return found

    def fit(self, texts: list[str]) -> Model:
        """Weights of the reliable places of the texts, by Newton's method."""
        rows: list[Vector] = []
        labels: list[float] = []
        for text in texts:
            for features, label in _reliable(text, self):
                rows.append(features)
                labels.append(label)
        for key, label in _listed():
            features = {"point": self.point_features, "pair": self.pair_features}[key[0]]
            rows.append(features(*key[1:]))
            labels.append(label)
        x, y = np.zeros((len(rows), len(NAMES))), np.array(labels)
        for i, row in enumerate(rows):
            for j, v in row:
                x[i, j] = v
        w = np.zeros(len(NAMES))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (p - y) + PENALTY * w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(w)), gradient)
            w = w - step * min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
            if np.abs(step).max() < 1e-6:
                break
        self.weights, self._scores = w, {}
        return self


def _matched(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost pairs of brackets and quotation marks of a paragraph."""
    if _QUOTED.search(text, start, end) is None:
        return []
    stack: list[tuple[str, int]] = []
    pairs = []
    for m in _TOKEN.finditer(text, start, end):
        ch, at = m[0][0], m.start()
        if ch in _STOPS:
            continue
        hit = next((i for i in range(len(stack) - 1, -1, -1) if ch in _PAIRS[stack[i][0]]), None)
        if ch == '"' and hit is not None and stack[-1][0] != '"' and stack[-1][0] not in _BRACKETS:
            hit = None
        if hit is not None:
            pairs.append((stack[hit][1], at))
            del stack[hit:]
        elif ch in _PAIRS:
            stack.append((ch, at))
    pairs.sort()
    out, last = [], -1
    for a, b in pairs:
        if a > last:
            out.append((a, b))
            last = b
    return out



def _listed() -> Iterator[tuple[tuple, float]]:
    """What the lists say, as one example an entry, with unknown words around: so a sample that lacks an entry does not forget it."""
    name = ("Unknown", "", True, True)
    for word in sorted(NEVER_FINAL):
        yield ("point", word, "", *name), 0.0
        yield ("point", word, "", "9", "9", True, False), 0.0
    for word in sorted(MAYBE_FINAL - NEVER_FINAL):
        yield ("point", word, "", *name), 1.0
    for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        yield ("point", letter, "", *name), 0.0
        yield ("point", letter, "exhibit", *name), 1.0
    for word in sorted(_MONTHS | _FOLLOWERS):
        yield ("point", "3", "", word, "", True, True), 0.0
    for word in sorted(_FOLLOWERS):
        yield ("point", "Co", "&", word, "", True, True), 0.0
    for number in ("7", "41", "2012", "4.2", "$1,200", "83.5"):
        yield ("point", number, "", *name), 1.0
        yield ("point", number, "", "Unknown", "«", True, False), 1.0
    for _ in range(12):
        # Quotations alone before a speaker or another sign without a blank go on; other pairs end before unknown words.
        yield ("pair", False, True, False, True, False, "Unknown"), 0.0
        yield ("pair", False, True, False, False, True, "~あん"), 0.0
        yield ("pair", False, False, False, False, False, "Unknown"), 1.0
        yield ("pair", True, True, False, False, False, "Unknown"), 1.0
        yield ("pair", True, False, True, False, False, "Unknown"), 0.0


#: Behind these signs no unit can begin.
_NO_START = frozenset(",;:-–—…)]，；、）")


def _candidates(text: str, start: int, end: int, model: Model, pairs: list[tuple[int, int]], training: bool = False) -> Iterator[tuple[int, int, int, tuple]]:
    """(at, stop, nxt, key) of the places of a paragraph that a mark could end: the mark, where a unit would end, what follows, what decides.

    ``key[0]`` is 'point', 'mark' or 'pair', the rest goes to the features of that sort.
    'alone' of a pair is left open (None): it depends on the units found so far.  For
    training, places where no unit can begin and the paragraph's end come too.
    """
    which = 0
    for m in _TOKEN.finditer(text, start, end):
        at, mark = m.start(), m[0]
        while which < len(pairs) and pairs[which][1] < at:
            which += 1
        if which < len(pairs) and pairs[which][0] <= at <= pairs[which][1]:
            a, b = pairs[which]
            if at != b or text[b - 1] not in _STOPS:
                continue
            stop = b + 1
            while stop < end and text[stop] in _CLOSERS and text[stop] not in '"“':
                stop += 1
            if stop < end and text[stop] in _STOPS:
                continue
            nxt = stop
            while nxt < end and text[nxt].isspace():
                nxt += 1
            sign = text[nxt] if nxt < end else ""
            if not training and (not sign or sign.islower() or sign in _NO_START):
                continue
            tight = nxt == stop and sign != "" and _caseless(sign)
            yield a, stop, nxt, ("pair", text[a] in _BRACKETS, None, text[b - 1] == ".", sign != "" and _SPEECH.match(text, nxt, end) is not None, tight, _after(text, nxt) if sign else "")
            continue
        if mark[0] not in _STOPS:
            continue
        stop = m.end()
        near = pairs[which : which + 2]
        while stop < end and text[stop] in _CLOSERS and not (text[stop] in '"“' and any(a == stop for a, _ in near)):
            stop += 1
        nxt = stop
        while nxt < end and text[nxt].isspace():
            nxt += 1
        sign = text[nxt] if nxt < end else ""
        if not training and (not sign or sign.islower() or sign in _NO_START):
            continue
        if mark == ".":
            yield at, stop, nxt, ("point", *model.point(text if sign else text[:nxt], at, stop, nxt, start))
        elif "…" in mark or (mark.startswith("..") and set(mark) <= {"."}):
            if at > start and not text[at - 1].isspace():
                yield at, stop, nxt, ("mark", "ellipsis", _after(text, nxt) if sign else "")
        else:
            yield at, stop, nxt, ("mark", "hard", "")


def _possible(text: str, stop: int, nxt: int, key: tuple) -> bool:
    """Whether a unit could begin at ``nxt``: no small letter, no comma, no sign within a token."""
    sign = text[nxt]
    if sign.islower() or sign in _NO_START:
        return False
    if key[0] == "point" and nxt == stop:
        return sign.isupper() or _caseless(sign) or sign in _PAIRS
    if key[1] == "ellipsis":
        return nxt > stop and (sign.isupper() or sign in "¿¡")
    return True


def _scored(key: tuple, model: Model) -> float:
    return model.score(key, model.point_features if key[0] == "point" else model.pair_features if key[0] == "pair" else model.mark_features)


def _reliable(text: str, model: Model) -> Iterator[tuple[Vector, float]]:
    """(features, label) of the places of a text whose label is sure."""
    features = {"point": model.point_features, "mark": model.mark_features, "pair": model.pair_features}
    spans = _paragraphs(text)
    for i, (start, end) in enumerate(spans):
        behind = spans[i + 1][0] if i + 1 < len(spans) else None
        unit = start
        for at, stop, nxt, key in _candidates(text, start, end, model, _matched(text, start, end), True):
            kind = key[0]
            if kind == "pair":
                key = (*key[:2], not text[unit:at].strip(), *key[3:])
            label = None
            if nxt >= end:
                # The end of a paragraph; what follows is the start of the next one.
                if behind is None or not (text[behind].isupper() or text[behind].isdigit() or _caseless(text[behind])):
                    continue
                if kind == "point":
                    key = ("point", *key[1:3], _after(text, behind), text[behind] if text[behind].isdigit() else "", True, False)
                else:
                    key = (*key[:-1], _after(text, behind))
                label = 1.0
            else:
                sign = text[nxt]
                if sign.islower() or sign in ",;":
                    # Of numbers and abbreviations that may end a sentence, going on says nothing about a capital behind.
                    open_ = kind == "point" and (_bare(key[1]) in MAYBE_FINAL or _NUMBER.fullmatch(key[1]) is not None)
                    label = 0.0 if (nxt > stop or kind != "point") and not open_ else None
                elif kind == "point":
                    label = _sure_point(key, sign, model)
                elif _possible(text, stop, nxt, key):
                    sure = model.start(key[-1]) > 1
                    if key[1] == "hard":
                        label = 1.0
                    elif kind == "pair" and not key[1]:
                        # A speaker behind a quotation, or a word that never starts, goes on.
                        label = 0.0 if ((key[4] or key[5]) and key[2]) or (_caseless(sign) and model.start(key[-1]) < -1) else 1.0 if sure else None
                    elif kind == "pair":
                        label = 0.0 if not key[2] and (key[3] or _caseless(sign)) else 1.0 if sure else None
                    else:
                        label = 1.0 if sure else None
            if label is not None:
                yield features[kind](*key[1:]), label
            if label == 1.0:
                unit = stop


def _sure_point(key: tuple, sign: str, model: Model) -> float | None:
    _, before, prior, word, _, space, proper = key
    bare, letters = _bare(before), before.replace(".", "")
    seen, _, cont = model.left.get(_key(before), (0, 0, 0))
    start = model.start(word)
    plain = len(letters) >= (2 if letters and _caseless(letters[0]) else 5) and letters.isalpha() and bare not in NEVER_FINAL and bare not in MAYBE_FINAL and cont * 50 <= seen
    if not space:
        if "." in before or "@" in before or "/" in before:
            return 0.0
        return 1.0 if plain and (proper or _caseless(sign)) and start >= 0 else None
    if sign.isdigit():
        return 0.0 if bare in NEVER_FINAL or (len(letters) <= 2 and letters.isalpha()) or (letters.isalpha() and seen >= 3 and cont * 2 > seen) else None
    if bare == "г" and prior[-1:].isdigit():
        return 1.0 if sign.isupper() else None
    if bare in NEVER_FINAL and not (bare in ("д", "п") and prior):
        return 0.0
    if len(letters) == 1 and prior.lower().strip("(,;:") in _LABELS:
        return 1.0 if sign.isupper() else None
    if len(letters) == 1 and letters.isupper():
        return 0.0
    if _NUMBER.fullmatch(before):
        return 0.0 if word.lower() in _MONTHS or word in _FOLLOWERS else 1.0 if start > 1 or (len(before) >= 4 and sign.isupper()) else None
    return 1.0 if plain and (sign.isupper() or _caseless(sign)) and start > 1 else None


def _paragraph(text: str, start: int, end: int, model: Model) -> list[int]:
    """Ends of the units within a paragraph without outer blanks, the last one left out."""
    cuts: list[int] = []
    unit = start
    pairs = _matched(text, start, end)
    for at, stop, nxt, key in _candidates(text, start, end, model, pairs):
        if not _possible(text, stop, nxt, key):
            continue
        if key[0] == "pair":
            key = (*key[:2], not text[unit:at].strip(), *key[3:])
        if _scored(key, model) > 0:
            cuts.append(stop)
            unit = stop
    if _THAI.search(text, start, end):
        more = [g.start() for g in _THAI_GAP.finditer(text, start, end) if not any(a < g.start() < b for a, b in pairs)]
        cuts = sorted({*cuts, *more})
    return cuts


def _paragraphs(text: str) -> list[tuple[int, int]]:
    """Paragraphs without the blanks around them."""
    out, at = [], 0
    for low, high in [*(m.span() for m in _BREAK.finditer(text)), (len(text), len(text))]:
        start, end = at, low
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start < end:
            out.append((start, end))
        at = high
    return out


def units(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentence units, without blanks around them."""
    out = []
    for start, end in _paragraphs(text):
        low = start
        for stop in [*_paragraph(text, start, end, model), end]:
            high = stop
            while low < high and text[low].isspace():
                low += 1
            while high > low and text[high - 1].isspace():
                high -= 1
            if low < high:
                out.append((low, high))
            low = stop
    return out


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left: dict[str, list[int]] = {}
    right: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(True, k, *v) for k, v in left.items()] + [(False, k, *v, 0) for k, v in right.items()]
        sides, words, *counts = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array(sides, pa.bool_()), pa.array(words, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=["point", "token", "x", "y", "z"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            token_counts(text, left, right)
        if len(left) + len(right) > 500_000:
            yield out()
            left.clear()
            right.clear()
    yield out()


def counts(documents: DataFrame, text_column: str = "text") -> tuple[dict[str, list[int]], dict[str, list[int]]]:
    """Token counts over all documents, without the tokens below ``RARE`` of their sort."""
    rows = documents.select(F.col(text_column).alias("text")).filter(F.length(F.trim("text")) > 0).mapInArrow(_count_rows, "point boolean, token string, x long, y long, z long")
    summed = cut(rows.groupBy("point", "token").agg(*(F.sum(c).alias(c) for c in "xyz")))
    size = F.when(F.col("point"), F.col("x")).otherwise(F.col("x") + F.col("y"))
    all_of = summed.groupBy("point").agg(F.sum(size).alias("all"))
    kept = summed.join(F.broadcast(all_of), "point").filter(size >= F.col("all") * RARE).drop("all").toArrow().to_pylist()
    return {r["token"]: [r["x"], r["y"], r["z"]] for r in kept if r["point"]}, {r["token"]: [r["x"], r["y"]] for r in kept if not r["point"]}


def train(documents: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> Model:
    """Counts of all documents, weights of at most ``TRAINING_DOCUMENTS`` whole ones, those of least hash."""
    spoken = documents.filter(F.length(F.trim(text_column)) > 0).select(F.xxhash64(F.col(id_column), F.lit(7)).alias("h"), F.col(text_column).alias("text"))
    # Rows under a hash threshold are about as many as wanted, so few texts are moved; the bound is exact.
    share = min(1.0, 2.0 * TRAINING_DOCUMENTS / max(1, documents.count()))
    rows = spoken.filter(F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).orderBy("h", F.xxhash64("text")).limit(TRAINING_DOCUMENTS).select("text").toArrow().column(0).to_pylist()
    return Model(*counts(documents, text_column)).fit(rows)


def sentence_units(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: Model | None = None) -> DataFrame:
    """``doc_id, start_char, end_char`` of every sentence unit.

    Null, empty and blank texts have none; repeated rows count once; rows with a
    null id are left out; a text without any mark is one unit a paragraph.
    """
    model = model or train(documents, text_column, id_column)
    kind = dict(documents.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for a, b in units(text, model):
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_char", "end_char"])

    chosen = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).filter("doc_id is not null and text is not null")
    return chosen.mapInArrow(run, f"doc_id {kind}, start_char int, end_char int").distinct()
