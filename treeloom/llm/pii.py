"""Personal data in texts by anchor expansion.

An Aho-Corasick automaton finds at-signs, schemes and identifier cues in one pass over a text;
from each anchor a small local parser walks outwards, settles where the item begins and ends and
validates it. Nothing is searched from every position, so a text of any length takes time in
proportion to it. Plus signs and runs of digits are anchors that need no automaton.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]

#: Anchors of the automaton: at-signs as they are and spelt out, schemes, cues of identifiers.
AT_SIGNS = ("@", "[at]", "(at)", "{at}", "＠")
SCHEMES = ("://", "mailto:", "tel:", "sip:", "xmpp:")
CUES = (
    "iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "social security", "passport", "passeport", "pasaporte", "reisepass",
    "tax id", "taxpayer id", "steuer-id", "steuernummer", "nif", "dni", "driver's license", "driving licence", "driver license", "customer id", "member id", "patient id", "card number",
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9]([\x20().0-9-]++)")
_WIDE_DOMAIN = re.compile(r"(?:[^\W_]|-)++(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?)(?:[^\W_]|-)++)++")
_QUOTED = re.compile(r'"(?:[^"\\\r\n]|\\.)++"$')
_URL = re.compile(r"[^\s<>\"'`{}|\\^]++")
_V6 = re.compile(r"\[([0-9A-Fa-f:.]++)\]")
_AFTER_CUE = re.compile(r"(?:nummer|s)?(?:[ \t]*+(?:number|no\.?|nr\.?|num\.?|id|is|ist|est|es|:|#|=|°))*+[ \t:#=]*+", re.I)
_GROUP = re.compile(r"[A-Z0-9]{1,40}+")
_VALUE = re.compile(r"[A-Z0-9]{1,40}+(?:[ ./-]?[A-Z0-9]{1,40}+){0,40}+")  # numbers have 34 characters at most
_DATE = re.compile(r"[0-9]{4}([ ./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([ ./-])[0-9]{1,2}\2[0-9]{2,4}")
_PERSONAL = re.compile(r"~[\w.-]+|@[\w.-]+|(?:users?|people|profile|u|in)/[\w.%-]+")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    """Whether letters and digits are an account number whose check digits fit (remainder 1 of 97)."""
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def plain_emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    """The leftmost addresses that don't overlap: each at-sign's run of local characters and its dotted domain."""
    out, free = [], 0
    for at in ats:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            out.append((start, found.end()))
            free = found.end()
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers of at most 255; longer chains are cut into fours from the left."""
    out = []
    for chain in _DIGIT_CHAIN.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    """A plus, a digit and what follows up to the last digit of its run, with something between them."""
    out = []
    for m in _PHONE.finditer(text):
        run = m.group(1).rstrip(" ().-")
        if len(run) >= 2 and 9 <= 1 + sum(map(str.isdigit, run)) <= 15:
            out.append((m.start(), m.start(1) + len(run)))
    return out


def wide_email(text: str, start: int, end: int, spelt: bool) -> tuple[int, int] | None:
    """The address around an at-sign whose local part is quoted or holds letters of any script, or that is spelt out."""
    left = start - (spelt and start > 0 and text[start - 1] == " ")
    begin = left
    if left and text[left - 1] == '"':
        opened = text.rfind('"', 0, left - 1)
        begin = opened if opened >= 0 and _QUOTED.match(text, opened, left) else left
    else:
        while begin and (text[begin - 1] in _LOCAL or text[begin - 1].isalnum()):
            begin -= 1
    found = _WIDE_DOMAIN.match(text, end + (spelt and text[end : end + 1] == " "))
    if begin >= left or not found:
        return None
    top = re.split(r"[.\]\)\}\s]", found.group())[-1]
    return (begin, found.end()) if len(top) >= 2 and top.isalpha() else None


def web_address(text: str, begin: int, at: int, end: int, word: str) -> tuple[int, int] | None:
    """The address with a scheme whose rest is ``text[at:end]``, if it names a person or a machine: a mailbox, number, login, personal path or bare host number."""
    rest = text[at:end]
    rest = rest.rstrip(".,;:!?" if "(" in rest else ".,;:!?)")
    if word == "://":
        host, _, path = rest.partition("/")
        personal = "@" in host[1:] or _V6.match(host) or _PERSONAL.match(path)
    else:
        personal = sum(map(str.isdigit, rest)) >= 7 if word == "tel:" else "@" in rest[1:-1]
    return (begin, at + len(rest)) if personal else None


def addresses(text: str, anchors: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """The addresses of the schemes at ``anchors``; a scheme within another's address is part of it."""
    out, free = [], 0
    for anchor, word in anchors:
        begin, at = anchor, anchor + len(word)
        while begin > free and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "+.-"):
            begin -= 1
        if anchor < free or (begin < anchor) != (word == "://") or not (rest := _URL.match(text, at)):
            continue
        free = rest.end()
        if found := web_address(text, begin, at, free, word):
            out.append(found)
    return out


def account(text: str, anchor: int, word: str) -> tuple[int, int] | None:
    """The value that follows an identifier's cue: letters and digits in groups, checked by kind."""
    end = anchor + len(word)
    if (anchor and text[anchor - 1].isalnum()) or not (begin := _AFTER_CUE.match(text, end).end()) > end or not (found := _VALUE.match(text, begin)):
        return None
    groups = [m.span() for m in _GROUP.finditer(text, begin, found.end())]
    if found.end() < len(text) and text[found.end()].isalnum():
        groups.pop()
    value = lambda: "".join(text[a:b] for a, b in groups)
    if word == "iban":
        while groups and not iban(value()):  # words in capitals may follow
            groups.pop()
        return (begin, groups[-1][1]) if groups else None
    while groups and not any(map(str.isdigit, text[slice(*groups[-1])])):
        groups.pop()
    number = value()
    digits = sum(map(str.isdigit, number))
    if word in ("ssn", "social security"):
        fits = digits == len(number) == 9
    else:
        fits = 6 <= len(number) <= 34 and digits >= 6 and 2 * digits >= len(number) and not _DATE.fullmatch(text, begin, groups[-1][1])
    return (begin, groups[-1][1]) if fits else None


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("at", AT_SIGNS), ("scheme", SCHEMES), ("cue", CUES)):
        for w in words:
            found.add_word(w, (kind, w))
    found.make_automaton()
    return found


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spans_of(text: str) -> list[tuple[str, int, int, bool]]:
    """``(kind, start, end, base)`` of all personal data, by kind as in KINDS, then start; code points, ends exclusive."""
    anchors = [(end - len(w) + 1, kind, w) for end, (kind, w) in automaton().iter(text.translate(_LOWER))]
    base = {"email": plain_emails(text, [a for a, _, w in anchors if w == "@"]), "ip": ips(text), "card": cards(text), "phone": phones(text)}
    out = {(kind, *span): True for kind in BASE for span in base[kind]}
    ends = {b: a for a, b in base["email"]}
    more = [("address", x) for x in addresses(text, [(a, w) for a, kind, w in anchors if kind == "scheme"])]
    for at, kind, word in anchors:
        if kind == "at" and (found := wide_email(text, at, at + len(word), word not in ("@", "＠"))) and found[0] < ends.get(found[1], len(text)):
            more.append(("email", found))
        elif kind == "cue" and (found := account(text, at, word)):
            more.append(("account", found))
    for kind, span in more:
        out.setdefault((kind, *span), False)
    return sorted(((k, a, b, was) for (k, a, b), was in out.items()), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_SPANS = "array<struct<kind:string,start:int,stop:int,base:boolean>>"


def find_pii(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, spans)``, a row for each row: spans in order, with whether a base rule found them.

    Null and empty texts have no spans; rows that repeat are searched alike; rows without an id
    are rows like others; other columns are ignored, whatever their names. Bytes that are no
    UTF-8 count as U+FFFD. A worker holds one text and its spans beside the batch.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            texts = ((x.as_py() or b"").decode("utf-8", "replace") for x in batch.column(1))
            found = [[{"kind": k, "start": a, "stop": b, "base": was} for k, a, b, was in spans_of(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"id long, spans {_SPANS}").withColumnRenamed("id", id)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans and the list of all spans, by document."""
    found = find_pii(docs, id, text)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind)))
    counts = [count(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(id, *counts, F.sha2(listed(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    Null texts stay null; texts without personal data stay as they are.
    """

    @F.pandas_udf("string")
    def cleaned(texts):
        return texts.map(lambda t: None if t is None else _cleaned(t))

    return docs.withColumn(text, cleaned(F.col(text)))


def _cleaned(text: str) -> str:
    out, at, reached = [], 0, 0
    for kind, a, b, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if a >= reached:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = reached = max(reached, b)
    return "".join([*out, text[at:]])
