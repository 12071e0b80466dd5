"""Personal data with offset-preserving deobfuscation.

Base spans are what the four patterns find in the text itself. Then a chain of transducers rewrites a tape of characters,
each of which knows the source characters it stands for: look-alikes, wide and invisible characters; at and dot disguises;
spelled digits. The same patterns run over the rewritten tape, and a span found there maps back to source characters. Such a
span is added unless it overlaps a base span of its kind; base spans stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, short_batches

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
#: A match begins where a run of digits does, as what must follow a run is the same from all places in it.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Letters of other alphabets that look like ASCII ones.
LOOK_ALIKES = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονıɡ", "ABEKMHOPCTYXaeopcyxijsdqwABEZHIKMNOPTYXovig"))
LOOK_ALIKES |= {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "｡": ".", "․": ".", "·": ".", "‧": ".", "∙": "."}
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
#: Spelled digits of the four languages.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_BETWEEN = r"[\s,.()-]{1,3}"
_ELEMENT = rf"(?:{_DIGIT_WORD}|[0-9]+)"
DIGITS = re.compile(rf"(?<!\w)(?:(?:plus|\+){_BETWEEN}|\+)?{_ELEMENT}(?:{_BETWEEN}{_ELEMENT})+(?!\w)", re.I)
#: A spelled digit beside a spelled or plain one: all runs of DIGITS that hold a spelled digit have it.
SPELLED_PAIR = re.compile(rf"(?<!\w){_DIGIT_WORD}{_BETWEEN}(?:{_DIGIT_WORD}(?!\w)|[0-9])|[0-9]{_BETWEEN}{_DIGIT_WORD}(?!\w)", re.I)
DIGIT_WORD = re.compile(_DIGIT_WORD, re.I)
WORD_OR_DIGIT = re.compile(rf"{_DIGIT_WORD}|(?:plus|\+){_BETWEEN}|[+0-9]", re.I)
LONG_RUN = re.compile(r"\+?(?:[0-9][\s,.()-]{0,3}){7,}[0-9]")
_DOT = "(?:dot|punkt|point|punto)"
_AT = "(?:at|ät|arobase|arroba|@)"
#: Top-level domains by which plain "at" and "dot" between words are an address and not prose.
_TOP = "(?:com|org|net|edu|gov|info|biz|io|dev|app|ai|co|eu|de|fr|es|it|uk|us|ch|at|nl|be|ca|au|mx)"
#: In brackets; the white space around goes with it.
BOXED_AT = re.compile(rf"[\[({{<]\s*+{_AT}\s*+[\])}}>]\s*+", re.I)
BOXED_DOT = re.compile(rf"[\[({{<]\s*+(?:{_DOT}|\.)\s*+[\])}}>]\s*+", re.I)
_LABELS = rf"[A-Za-z0-9-]+(?:(?:\s+{_DOT}\s+|\x00|\.)[A-Za-z0-9-]+)+"
BARE_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-])\s+(?P<at>at|arobase|arroba|@)\s+(?=(?P<domain>{_LABELS}))", re.I)
KNOWN_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:\x00[A-Za-z0-9-]|(?:(?:\s+{_DOT}\s+|\.)[A-Za-z0-9-]+)*\s+{_DOT}\s+{_TOP}(?![A-Za-z0-9-]))", re.I)
LABEL_DOT = re.compile(rf"(\s+{_DOT}\s+|\x00|\.)", re.I)
#: Longer top-level labels that plain "at" and "dot" need; other signs or real dots go with any label.
_LONG_TOP = frozenset("info name asia jobs mobi online shop site store tech cloud club email blog live news world life agency digital solutions academy museum travel design studio media group global network services software systems".split())
#: Fixed values, by which prose is told from an address: words that end no address, that begin no domain, and that come before "at" or "@".
_NO_TOP = frozenset("the and for but nor that this these those which who whom whose what when where why how with from into onto over under near not was were had has his her its our you she him they them their then than there out off via per may can did does all any are one two let yet too now of or if he we as by an on is was und der die das den dem auf ein mit von ist bei les des une est dans sur par pour los las una del con por que html htm php txt pdf png jpg gif css json xml csv doc zip exe".split())
_NO_FIRST = frozenset("the a an this that these those some any no one each every which what another its his her our your their my most least".split())
_PROSE = frozenset("look looks looked looking stare stares stared staring point points pointed pointing glance glanced gaze gazed aim aimed meet meets met us me him her them it he she they we you is are was were be been am here there up sign signed log logged online available hosted live site website page pages blog visit see seen read more found find published work works worked working arrive arrives arrived shop buy order orders stop stopped start started begin began stay stayed stayed listed located and or not but only even".split())
DOMAIN = re.compile(rf"@[A-Za-z0-9-]+(?:(?:\s+{_DOT}\s+|\x00|\.)[A-Za-z0-9-]+)+", re.I)
BARE_DOT = re.compile(rf"\s+{_DOT}\s+", re.I)
_LABEL_SET = _LOCAL_SET - {"."}
_DOT_WORDS = ("dot", "punkt", "point", "punto")
DOTTED_DIGITS = re.compile(rf"(?<![0-9])[0-9]+(?:(?:\s+{_DOT}\s+|\x00|\.)[0-9]+){{3}}(?![0-9])", re.I)
_NUMBER = rf"(?:[0-9]{{2,}}|(?:{_DIGIT_WORD}|[0-9])(?:[\s-]{{1,3}}(?:{_DIGIT_WORD}|[0-9])(?!\w)){{0,2}})"
SPELLED_IP = re.compile(rf"(?<!\w){_NUMBER}(?:(?:\s+{_DOT}\s+|\x00|\.){_NUMBER}){{3}}(?!\w)", re.I)
_IP_PART = re.compile(rf"{_DIGIT_WORD}|[0-9]|{_DOT}|\x00|\.", re.I)
_ODD = re.compile("[" + re.escape("".join(LOOK_ALIKES) + INVISIBLE) + "٠-٩０-９Ａ-Ｚａ-ｚ＠．－＋]")
_DISGUISED = re.compile(rf"\s{_DOT}\s|\s@\s|\s(?:at|arobase|arroba)\s+[A-Za-z0-9-]+\.|[\[({{<]\s*(?:{_DOT}|{_AT}|\.)\s*[\])}}>]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL: a match has one @, and begins where the run of local characters before it does."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL_SET:
            begin -= 1
        m = EMAIL.match(text, begin) if begin < at else None
        if m:
            out.append(m.span())
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind: leftmost, not overlapping within a kind; matches that fail the kind's test are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if DIGIT.search(text):
        found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return found


class Tape:
    """Text whose characters know their source span."""

    def __init__(self, text: str) -> None:
        self.text, self.begin, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, pattern: re.Pattern, output) -> None:
        """Each match becomes output(match); a new character stands for the whole match, the others stay. A match whose output is None stays too."""
        parts, begin, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            new = output(m)
            if new is None:
                continue
            parts += [self.text[at:a], new]
            begin += [*self.begin[at:a], *[self.begin[a]] * len(new)]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(new)]
            at = b
        if at:
            self.text = "".join([*parts, self.text[at:]])
            self.begin, self.end = [*begin, *self.begin[at:]], [*end, *self.end[at:]]

    def boxed(self, pattern: re.Pattern, new: str) -> None:
        """Each match, with the white space before it, becomes new."""
        spans, end = [], 0
        for m in pattern.finditer(self.text):
            begin = m.start()
            while begin > end and self.text[begin - 1].isspace():
                begin -= 1
            spans.append((begin, m.end()))
            end = m.end()
        self.replace(spans, new)

    def replace(self, spans: list[tuple[int, int]], new: str) -> None:
        """Each of the spans (in order, not overlapping) becomes new."""
        parts, begin, end, at = [], [], [], 0
        for a, b in spans:
            parts += [self.text[at:a], new]
            begin += [*self.begin[at:a], *[self.begin[a]] * len(new)]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(new)]
            at = b
        if at:
            self.text = "".join([*parts, self.text[at:]])
            self.begin, self.end = [*begin, *self.begin[at:]], [*end, *self.end[at:]]

    def inside(self, outer: re.Pattern, inner: re.Pattern, output, only=None) -> None:
        """rewrite(inner) within the matches of outer (for which only holds)."""
        spots = {(m.start() + n.start(), m.start() + n.end()) for m in outer.finditer(self.text) if only is None or only(m) for n in inner.finditer(m[0])}
        if spots:
            self.rewrite(re.compile(inner.pattern, inner.flags), lambda n: output(n) if n.span() in spots else None)

    def rewritten(self, m: re.Match) -> bool:
        """A character of the match stands for several of the source."""
        return any(self.end[i] - self.begin[i] > 1 for i in range(*m.span()))


def dots_before_at(text: str) -> list[tuple[int, int]]:
    """Spans of spelled dots between the labels that lead up to each @. Labels hold no @, so no part of the text is read twice."""
    out, at = [], text.find("@")
    while at >= 0:
        found, i = [], at
        while True:
            k = i
            while k and text[k - 1] in _LABEL_SET:
                k -= 1
            if k == i:  # no label: what was taken for a dot before it is none
                found = found[:-1]
                break
            if k and text[k - 1] == "\0":
                found.append((k - 1, k))
                i = k - 1
                continue
            e = k
            while e and text[e - 1].isspace():
                e -= 1
            word = next((w for w in _DOT_WORDS if e < k and text[max(0, e - len(w)) : e].lower() == w), None)
            b = e - len(word) if word else e
            s = b
            while word and s and text[s - 1].isspace():
                s -= 1
            if not word or s == b:
                break
            found.append((s, k))
            i = s
        out += found[::-1]
        at = text.find("@", at + 1)
    return out


def _letter(m: re.Match) -> str:
    c = m[0]
    return "" if c in INVISIBLE else LOOK_ALIKES.get(c) or unicodedata.normalize("NFKC", c if not c.isdigit() else str(unicodedata.digit(c)))


def _digit(m: re.Match) -> str:
    word = m[0].lower()
    return "+" if word.startswith(("plus", "+")) else SPELLED.get(word, word)


def _ip(m: re.Match) -> str | None:
    """The address in plain digits; None if no digit is spelled."""
    if not DIGIT_WORD.search(m[0]):
        return None
    parts = (n[0].lower() for n in _IP_PART.finditer(m[0]))
    return "".join(SPELLED.get(x, x if x.isdigit() else ".") for x in parts)


def _at(m: re.Match) -> str | None:
    """@ if the words around are an address and not prose."""
    if KNOWN_DOMAIN.match(m.string, m.end()):
        return "@"
    parts = LABEL_DOT.split(m["domain"])
    labels, dots = parts[::2], parts[1::2]
    plain = m["at"].lower() == "at"
    # what follows the first label that is no part of a domain is the text that goes on
    first = labels[0].lower()
    if first in _NO_FIRST or not any(c.isalpha() for c in first) or (plain and LOCAL.search(m.string, max(0, m.start() - 64), m.start())[0].lower() in _PROSE):
        return None
    top, dot = labels[1], dots[0]
    for label, mark in zip(labels[2:], dots[1:]):
        if label.lower() in _NO_TOP or not label[0].islower() and mark == ".":
            break
        top, dot = label, mark
    if not (top.isalpha() and 2 <= len(top) <= 24) or top.lower() in _NO_TOP or not (top.islower() or top.isupper()):
        return None
    return "@" if not plain or dot.strip() in (".", "\0") or len(top) <= 3 or top.lower() in _LONG_TOP else None


def normalise(text: str) -> Tape | None:
    """The tape after all transducers; None if there is nothing that they would rewrite."""
    odd, disguised, spelled = (p.search(text) for p in (_ODD, _DISGUISED, SPELLED_PAIR))
    if not (odd or disguised or spelled):
        return None
    tape = Tape(text)
    if odd:
        tape.rewrite(_ODD, _letter)
    tape.boxed(BOXED_AT, "@")
    tape.boxed(BOXED_DOT, "\0")
    tape.rewrite(SPELLED_IP, _ip)
    tape.rewrite(BARE_AT, _at)
    tape.inside(DOMAIN, BARE_DOT, lambda m: ".")
    tape.replace(dots_before_at(tape.text), ".")
    tape.inside(DOTTED_DIGITS, BARE_DOT, lambda m: ".")
    tape.rewrite(re.compile("\0"), lambda m: ".")
    if odd or spelled:
        tape.inside(DIGITS, WORD_OR_DIGIT, _digit, lambda m: DIGIT_WORD.search(m[0]))
        # plain digits alone are read by the base patterns, odd ones as spelled ones
        only = None if odd else tape.rewritten
        tape.inside(LONG_RUN, re.compile(r"[\s,]{1,3}"), lambda m: " ", only)
        tape.inside(LONG_RUN, re.compile(r"(?<=[+0-9]) (?=[0-9] ?(?![0-9]))"), lambda m: "", only)
    return tape


def scan(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, int]]]:
    """Base spans by kind, and all spans as (number of the kind, start, end) in order."""
    base = find(text)
    spans = [(k, a, b) for k, kind in enumerate(KINDS) for a, b in base[kind]]
    tape = normalise(text)
    if tape is not None:
        more = find(tape.text)
        for k, kind in enumerate(KINDS):
            ends = [y for _, y in base[kind]]
            for a, b in more[kind]:
                a, b = tape.begin[a], tape.end[b - 1]
                next_ = bisect_right(ends, a)  # the first base span that ends after a
                if next_ == len(ends) or base[kind][next_][0] >= b:
                    spans.append((k, a, b))
        spans.sort()
    return base, spans


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in each row of docs (doc_id, text).

    n_email to n_phone count the base spans, base_sha256 is the digest of their list, spans lists base and added spans
    (kind:start:end in code points, end exclusive, by kind and start), n_added counts the added ones. Null text counts as
    empty: no spans. A null doc_id stays null, repeated rows give repeated rows, an empty table an empty result; other columns
    are not read.
    """
    short_batches(docs.sparkSession)
    out = arrow_schema(docs.sparkSession, SCHEMA)

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in out]
            for text in batch.column(1):
                base, spans = scan(text.as_py() or "")
                kept = [(k, a, b) for k, kind in enumerate(KINDS) for a, b in base[kind]]
                row = [*(len(base[k]) for k in KINDS), hashlib.sha256(_joined(kept).encode()).hexdigest(), _joined(spans), len(spans) - len(kept)]
                for c, x in zip(columns[1:], row):
                    c.append(x)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns[1:], list(out)[1:]))], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
