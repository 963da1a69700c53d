"""Tokenizer alignment, vector codes and personal data against plain versions on small, awkward tables."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers

from treeloom.llm import alignment, codebooks, oracles, pieces, pii

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, key string, groups string, spans string, n long"
ODD = [
    None, "", " ", "  lead", "trail  ", "\n", "a b", "The cat's  don't 12 cats\n\nnew", "über straße éè ñandú", "日本語のテキスト と 空白", "x" * 500, "▁mark", "a ▁ b", "<s> </s> <|endoftext|> <0x41>", "\x00\x01", "é" * 40 + " é x",
    "no break  wide", "😀 😀😀 a😀b", "tab\tand\r\nline", "the the the the", "the the the the", "1 2 33 4444 don't  can't", "🏳️‍🌈 ‍ x",
]


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.load_json(public_tokenizers.path("byte_bpe_50k.json")), pieces.load_model(public_tokenizers.path("piece_bpe_32k.model"))


def docs(spark, texts):
    return spark.createDataFrame([(i // 2 if i != 3 else None, t, "k", "g", "s", 1) for i, t in enumerate(texts)], DOCS)


def plain_alignment(texts, kind="end"):
    """Whole texts by the libraries, every group and every link one by one."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of = alignment._byte_of()
    raw_a = lambda i: bytes(of[c] for c in a.id_to_token(i))
    raw_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if not t or b"".join(map(raw_a, x)) != (" " + t).encode() or b"".join(map(raw_b, y)) != (" " + t).encode():
            out.append((0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(raw_a(i)) for i in x]).tolist(), np.cumsum([len(raw_b(i)) for i in y]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        group = lambda ids, ends, lo, hi: ",".join(str(i) for i, e in zip(ids, ends, strict=True) if lo < e <= hi)
        groups = [f"{group(x, ends_a, lo, hi)}|{group(y, ends_b, lo, hi)}" for lo, hi in zip([0, *both], both, strict=False)]
        if kind == "end":
            links = [(i, j) for i, e in zip(x, ends_a, strict=True) for j, f in zip(y, ends_b, strict=True) if e == f]
        else:
            spans = lambda ids, ends: list(zip(ids, [0, *ends], ends, strict=False))
            links = [(i, j) for i, s, e in spans(x, ends_a) for j, u, f in spans(y, ends_b) if s < f and u < e]
        counts.update(links)
        out.append((len(x), len(y), groups, links))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [
        (n, m, len(g), len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for n, m, g, ls in out
    ]


@pytest.mark.parametrize("kind", ["end", "overlap"])
def test_alignment(spark, vocabularies, kind, monkeypatch):
    monkeypatch.setattr(alignment, "HOT", 64)  # both joins get rows
    real = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts = ODD + [t[:700] for t in real] + real[:2]
    got = alignment.align(docs(spark, texts), *vocabularies, kind=kind)
    want = [(i // 2 if i != 3 else None, *row) for i, row in enumerate(plain_alignment(texts, kind))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_units_equal_whole_texts(spark, vocabularies, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5000)
    monkeypatch.setattr(alignment, "ROW", 3000)
    x = alignment.aligner(*vocabularies)
    assert x.splits
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text] + [t for t in ODD if t]
    got = [r for at in range(0, len(texts), 30) for r in x.align(texts[at : at + 30])]
    for t, (n_a, n_b, written, groups) in zip(texts, got, strict=True):
        ((whole, each, a, b),) = x.units([t]) or [("", (), 0, 0)]
        assert (n_a, n_b, written, groups) == (a, b, whole, Counter(each))


def test_alignment_of_nothing(spark, vocabularies):
    assert alignment.align(docs(spark, ["x"]).limit(0), *vocabularies).collect() == []
    assert [tuple(r) for r in alignment.align(docs(spark, [None]), *vocabularies).collect()] == [(0, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_by_documents(spark, vocabularies):
    """A pair's weight is then the documents with it, not its links."""
    got = {r.doc_id: r for r in alignment.align(spark.createDataFrame([(1, "cat cat cat"), (2, "cat")], "doc_id long, text string"), *vocabularies, weight="docs").collect()}
    assert got[1].count_sum == 6 and got[2].count_sum == 2


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, q string"


def plain_codes(rows, entries):
    """``rows`` are (vec_id, vector, label): exact whole numbers throughout."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(kept[0][1])
    at = [i * dims // 4 for i in range(5)]
    part = lambda v, p: v[at[p] : at[p + 1]]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(4)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    assign = lambda v, p: min(range(len(books[p])), key=lambda i: (far(part(v, p), books[p][i]), i))
    for _ in range(4):
        new = [list(b) for b in books]
        for p in range(4):
            held = {}
            for _, v, _ in kept:
                held.setdefault(assign(v, p), []).append(part(v, p))
            for i, xs in held.items():
                new[p][i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
        books = new
    out = []
    for i, v, label in kept:
        code = [assign(v, p) for p in range(4)]
        out.append((i, "".join(f"{c:02x}" for c in code), sum(far(part(v, p), books[p][code[p]]) for p in range(4)), label))
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, sums[label], sha) for i, c, e, label in out]


def vectors(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dims).astype(np.float32)], int(rng.integers(3)) if i % 7 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * dims, 1), (n + 2, [None] * dims, 0), (n + 3, [float("inf")] * dims, 0), (None, rows[0][1], 2), (5, rows[5][1], rows[5][2]), (n + 4, [0.0] * dims, 1)]
    return rows


@pytest.mark.parametrize(("n", "dims", "entries"), [(90, 8, 16), (12, 8, 256), (40, 10, 8)])
def test_codes(spark, n, dims, entries):
    rows = vectors(n, dims)
    df = spark.createDataFrame([(*r, "c", "e", "q") for r in rows], VECTORS).repartition(3)
    got = codebooks.compress(df, entries=entries).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_codes(rows, entries), key=repr)


def test_codes_of_other_lengths_and_sizes(spark):
    """Vectors that can't be coded keep their row; an empty table gives an empty one."""
    rows = [(0, [1.0] * 8, 1), (1, [2.0] * 8, 1), (2, [1.0] * 6, 1), (3, [1e30] * 8, 2), (4, [], 2)]
    df = spark.createDataFrame([(*r, "c", "e", "q") for r in rows], VECTORS)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codebooks.compress(df).collect()}
    assert got == {0: ("00000000", 0, 0), 1: ("01010101", 0, 0), 2: (None, None, 0), 3: (None, None, None), 4: (None, None, None)}
    assert codebooks.compress(df.limit(0)).collect() == []
    assert [r.code for r in codebooks.compress(df.where("vec_id = 4")).collect()] == ["00000000"]


def test_codes_equal_their_sql(spark):
    got = codebooks.compress(spark.read.parquet(f"{DATA}/embeddings.parquet")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(oracles.OP12).fetchall())


def test_decoded_vectors_are_near():
    books = codebooks.Codebooks(tuple(np.array([[0, 1024], [512, -512]], np.int64) for _ in range(4)))
    assert books.decode("00010001")[:4] == [0.5 / 1024, 1 + 0.5 / 1024, 0.5 + 0.5 / 1024, -0.5 + 0.5 / 1024]


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The base rules as regular expressions, left to right."""
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    keep = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)),
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, rule in RULES.items() for m in re.finditer(rule, text or "") if keep[k](m.group())]


SAMPLES = [
    None, "", "x", "a@b.c", "a@b.c@d.ef", ".x@y.zz. b@c", "a@b..c a@-.-", "@@a@b.c", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.1.1.1", "0001.02.3.255", "1..2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "12 4111111111111111",
    "+1 (132) 555-1352 x", "+12", "+1-", "+123456789", "+49 30 1234567 and +4 5", "+1 2345678901234567890", "++49 30 1234567", "é.x@y.de über", "a" * 3000, "1" * 5000, "1." * 3000, "a@" * 2000, "+1" * 2000,
]


def test_base_spans(spark):
    rng = random.Random(4)
    alphabet = ["a", "Z", "9", "1", "0", ".", "@", "-", "+", " ", "(", ")", "_", "\n", "é", "12", "4111 1111 1111 1111", "1.2.3.4"]
    made = SAMPLES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    got = {i: r for i, r in enumerate(pii.spans_of(t or "") for t in made)}
    for i, t in enumerate(made):
        assert [(k, a, b) for k, a, b, base in got[i] if base] == plain_spans(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("schreib an jürgen.groß@müller.de bald", "email", "jürgen.groß@müller.de"),
        ("ask ann [at] site [dot] org today", "email", "ann [at] site [dot] org"),
        ('from "Ann B."@site.org now', "email", '"Ann B."@site.org'),
        ("see ftp://ann:pw@host/x.", "address", "ftp://ann:pw@host/x"),
        ("(http://site.org/~ann)", "address", "http://site.org/~ann"),
        ("http://[2001:db8::1]/x", "address", "http://[2001:db8::1]/x"),
        ("mailto:ann@site.org,", "address", "mailto:ann@site.org"),
        ("tel:+49-30-1234567", "address", "tel:+49-30-1234567"),
        ("IBAN: DE89 3704 0044 0532 0130 00 AND MORE", "account", "DE89 3704 0044 0532 0130 00"),
        ("Kontonummer 12345678, BLZ", "account", "12345678"),
        ("his SSN is 078-05-1120.", "account", "078-05-1120"),
        ("passport no. C01X0TTK", "account", None),
        ("passport no. C01X00474 HELD", "account", "C01X00474"),
        ("IBAN DE88 3704 0044 0532 0130 00", "account", None),
        ("account 2024-01-15", "account", None),
        ("accounting 12345678", "account", None),
        ("http://site.org/page", "address", None),
        ("Hotel: 5551234567", "address", None),
        ("look at me. dot", "email", None),
    ],
)
def test_added_spans(text, kind, found):
    assert [text[a:b] for k, a, b, base in pii.spans_of(text) if k == kind and not base] == ([found] if found else [])


def test_report_and_redaction(spark):
    df = docs(spark, [*SAMPLES, "mail a@b.c or +49 30 1234567", "mail a@b.c or +49 30 1234567"])
    rows = pii.report(df).collect()
    want = []
    for r in df.collect():
        base = plain_spans(r.text)
        listed = lambda xs: ",".join(":".join(map(str, x)) for x in xs)
        n = Counter(k for k, _, _ in base)
        want.append((r.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(listed(base).encode()).hexdigest(), listed(s[:3] for s in pii.spans_of(r.text or ""))))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert pii.report(df.limit(0)).collect() == []
    clean = {r.text for r in pii.redact(df.where("text like 'mail%' or text is null")).collect()}
    assert clean == {"mail <EMAIL> or <PHONE>", None}


def test_spans_take_time_in_proportion():
    import time

    hard = ["http://" * 60_000, '"@' * 200_000, "DNI " * 100_000, "a" * 1_000_000, "1" * 1_000_000, "x [at] " * 60_000, "http://x" + ")" * 400_000, "é@" * 200_000, "iban A1 " * 50_000]
    for t in hard:
        began = time.process_time()
        pii.spans_of(t)
        assert time.process_time() - began < 10, t[:20]
