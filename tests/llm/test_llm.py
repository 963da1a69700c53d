"""Each operator against a plain version on small, awkward tables: nulls, empty and long texts, ties, repeats,
empty tables and further columns with clashing names."""

import dataclasses
import hashlib
import html as html_lib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import public_tokenizers

from treeloom.llm import ann, common, components, html, licences, mixing, pieces, quality, shards, simhash, suffix, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, ids string, row string"


def documents(spark, texts, ids=None):
    rows = [(i, t, ["en", "de", None][k % 3], [None, "a", "b"][k % 3], None if t is None else len(t), 7, "x", "y") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    made = [None, "", " \t\n", "one", "one two three", "é" * 60, "-" * 400, "# *" * 80, "\x00" * 120]
    base = [say(rng.randrange(20, 250)) for _ in range(25)]
    for b in base:
        made += [b, b] if rng.random() < 0.4 else [b]
        if rng.random() < 0.5:
            w = b.split()
            w[len(w) // 2] = "changed"
            made.append(" ".join(w))
    passage = say(30)
    made += [say(40) + "\n" + passage + "\n" + say(40) for _ in range(4)] + ["\n".join([say(8)] * 20), say(6000)]
    return made


def collect(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 1), (5, 5)]
    parent = {}
    find = lambda a: a if parent.setdefault(a, a) == a else find(parent[a])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {a: find(a) for a in list(parent)}
    assert components.connected_components(df.where("src < 0")).count() == 0


# op1


def plain_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q, x in ok:
        if q % 5 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q)[:k]
            out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [0, 4, 300])
def test_nearest(spark, n, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "PIECE", 50)
    rng = np.random.default_rng(n)
    same = [1.0] * 8
    rows = [(i, same if i % 3 == 0 else rng.standard_normal(8).round(2).tolist()) for i in range(n)]
    rows += [(1000, None), (1005, [0.0] * 8), (1010, [float("nan")] * 8), (1015, [None] * 8), (1020, [float("inf")] * 8), (None, same), (1025, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<float>, score double, rank int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = collect(ann.nearest(df, F.col("vec_id") % 5 == 0), "query_id", "rank", "vec_id", "score")
    assert got == plain_nearest(rows, 10)


@pytest.mark.parametrize("dim", [64, 100])
def test_codes_bound_distances(dim):
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2000, dim)), rng.standard_normal((50, dim))
    coder = ann.Coder.fit(x[:500])
    own, bits, norm, inner = coder.encode(x)
    least, true = np.empty((2000, 50)), ((x[:, None] - q[None]) ** 2).sum(axis=2)
    for c in range(len(coder.centroids)):
        least[own == c] = coder.least(bits[own == c], norm[own == c], inner[own == c], coder.turned(c, q))
    assert bits.shape == (2000, -(-dim // 64)) and (least <= true + 1e-6).mean() > 0.9999 and least.mean() > 0.3 * true.mean()


def test_recall_over_the_whole_table(spark):
    """All queries of the contract over all rows of the test data, against brute force."""
    from treeloom.llm.queries import QUERIES

    where = "/root/testdata/sf0.1"
    found = {}
    for r in QUERIES["op1_nearest_neighbours"](spark, where).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = spark.read.parquet(f"{where}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want = [j for j in np.lexsort((ids, d)) if j != i][:10]
        got = sorted(found[ids[i]])
        assert [g[0] for g in got] == list(range(1, 11)) and all(g[2] == pytest.approx(d[ids == g[1]][0]) for g in got)
        hits += len({g[1] for g in got} & set(ids[want].tolist()))
        total += 10
    assert len(found) * 10 == total and hits >= 0.99 * total


# op2


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    kinds = sorted(set(prints.values()))
    parent = {k: k for k in kinds}
    find = lambda a: a if parent[a] == a else find(parent[a])
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(b)] = find(a)
    least = {}
    for i, f in prints.items():
        least[find(f)] = min(least.get(find(f), i), i)
    return {i: least[find(f)] for i, f in prints.items()}


@pytest.mark.parametrize("heavy,block", [(20, 2048), (2, 3)])
def test_simhash(spark, texts, heavy, block, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    monkeypatch.setattr(simhash, "TIMES", 0)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    groups = plain_groups(prints)
    df = documents(spark, texts)
    got = collect(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id")
    assert got == sorted([(i, f"{prints[i]:016x}", groups[i]) for i in prints], key=repr)
    kept = simhash.keep_first(df, simhash.Kind())
    assert kept.columns == df.columns and collect(kept, "doc_id", "text") == sorted([(i, texts[i]) for i in prints if groups[i] == i], key=repr)
    assert simhash.near_duplicates(df.where("doc_id < 0")).count() == simhash.keep_first(df.where("doc_id < 0")).count() == 0


def test_rows_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    df = documents(spark, [a, b, a, a, None, c, c, None], ids=[1, 1, 1, 2, 3, None, None, 4])
    got = collect(simhash.keep_first(df), "doc_id", "text", "row")
    assert got == sorted([(1, a, "y"), (1, b, "y"), (3, None, "y"), (None, c, "y"), (None, c, "y")], key=repr)
    judged = collect(simhash.near_duplicates(df), "doc_id", "component_id")
    assert judged == sorted([(1, 1)] * 3 + [(2, 1), (3, 3), (4, 3)] + [(None, None)] * 2, key=repr)


def as_classes(spark, prints, bits):
    return spark.createDataFrame([((f & 2**64 - 1) - (f >> 63 & 1) * 2**64, f.to_bytes(bits // 8, "little")) for f in prints], "node long, fp binary")


@pytest.mark.parametrize("heavy", [30, 1000])
def test_dense_fingerprints(spark, heavy, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    monkeypatch.setattr(simhash, "TIMES", 0)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) if i < 200 else rng.getrandbits(64) for i in range(400)})
    df = as_classes(spark, prints, 64)
    plan = simhash.fit_plan(df, len(prints))
    signed = {f - (f >> 63 << 64): f for f in prints}
    got = {r.node: r.component for r in components.connected_components(simhash.linked_pairs(df, plan)).collect()}
    assert {i: got.get(i, i) for i in signed} == plain_groups(signed)
    assert sum(len(p) for p in plan.parts) == 64
    bits = np.unpackbits(np.array(prints, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    chosen = dataclasses.replace(plan, n=10**7).thresholds(plan.values(bits))  # so many that crowded values are to be shunned
    assert (chosen.sum(axis=1) == 4 - len(plan.parts) + 1).all() and len(np.unique(chosen, axis=0)) > 1


def shingle_sets(texts):
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return [runs((t or "").lower().split()) for t in texts]


@pytest.mark.parametrize("heavy,block", [(20, 2048), (3, 8)])
def test_similar_texts(spark, texts, heavy, block, monkeypatch):
    """Against all pairs: the same groups as by the fingerprints' own radius, and what true similarity asks for."""
    import corpus_pipeline

    monkeypatch.setattr(simhash, "HEAVY", heavy)
    monkeypatch.setattr(simhash, "TIMES", 0)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    made = [*texts]
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 300))]
        made.append(" ".join(base))
        for _ in range(12 if k == 0 else 3):
            made.append(" ".join(rng.choice(words) if rng.random() < 0.01 * (k % 3) else w for w in base))
    sets, group = shingle_sets(made), list(range(len(made)))
    close = [(i, j) for j in range(len(made)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in close:
        low, high = sorted((group[i], group[j]))
        group = [low if g == high else g for g in group]
    df = documents(spark, made)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, simhash.similar(len(made))).collect()}
    assert len([1 for i, j in close if sets[i] != sets[j]]) > 60 and got == dict(enumerate(group))
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(made)) if group[i] == i]


def test_pairs_at_the_edge(spark):
    """Pairs just below 0.8 stay apart, pairs just above are found but for a few."""
    rng, made = random.Random(12), []
    for k in range(150):
        base = [f"v{rng.randrange(9000)}" for _ in range(200)]
        other, at = [*base], 0
        while True:  # changes from the front on until the similarity falls to the edge
            x, y = shingle_sets([" ".join(base), " ".join(other)])
            if len(x & y) / len(x | y) < 0.81:
                break
            other[at] = f"u{at}"
            at += 7 if at < 60 else 1
        other = [w if i != at - 1 or k % 2 else base[i] for i, w in enumerate(other)]
        made += [" ".join(base), " ".join(other)]
    sets = shingle_sets(made)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, made), simhash.similar(len(made))).collect()}
    share = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 300, 2)]
    tied = [got[i] == got[i + 1] for i in range(0, 300, 2)]
    assert not any(t for t, x in zip(tied, share, strict=True) if x < 0.8) and all(got[i] in (i, i - 1) for i in got)
    above = [t for t, x in zip(tied, share, strict=True) if x >= 0.8]
    assert len(above) > 40 and sum(above) >= 0.95 * len(above)


def test_wide_fingerprints_estimate_similarity():
    kind, rng = simhash.similar(200_000), random.Random(4)
    words = [f"w{i}" for i in range(20_000)]
    for changed, size in ((1, 60), (2, 100), (5, 250), (30, 250)):
        seen = []
        for _ in range(20):
            a = rng.sample(words, size)
            b = [*a]
            for at in rng.sample(range(size), changed):
                b[at] = "changed" + b[at]
            x, y = shingle_sets([" ".join(a), " ".join(b)])
            p = (int.from_bytes(simhash.fingerprint(" ".join(a).encode(), kind)) ^ int.from_bytes(simhash.fingerprint(" ".join(b).encode(), kind))).bit_count() / kind.bits
            seen.append(p - simhash.differing(len(x & y) / len(x | y)))
        assert abs(sum(seen) / 20) < 0.01 and max(map(abs, seen)) < 0.05
    assert all(simhash.similar(n).missed(0.8) <= 0.01 for n in (10, 10**4, 200_000, 12_000_000, 10**9))


# op3


def plain_removals(rows):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        covered = bytearray(len(data))
        for s in range(len(data) - 49):
            if seen.setdefault(data[s : s + 50], i) < i:
                covered[s : s + 50] = b"\1" * 50
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out.append((i, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,hot,batch,chunk", [(40_000, 20_000, 1 << 24, 1 << 20), (20, 20_000, 5_000, 600), (40_000, 1, 3_000, 200)])
def test_suffix(spark, texts, shard, hot, batch, chunk, monkeypatch):
    for k, v in (("SHARD", shard), ("HOT", hot), ("BATCH", batch), ("CHUNK", chunk)):
        monkeypatch.setattr(suffix, k, v)
    df = documents(spark, texts)
    got = collect(suffix.removals(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain_removals(list(enumerate(texts)))


def test_suffix_edges(spark):
    long = "".join(random.Random(4).choice("xyz ") for _ in range(200))
    df = documents(spark, [long, long, "other", long], ids=[3, 3, None, None])
    assert [r.n_removed for r in suffix.removals(df).collect()] == [0, 0, 0, 0]
    assert suffix.removals(df.where("doc_id < 0")).count() == 0
    cut = documents(spark, ["é" + "a" * 50, "éx" + "a" * 50, None])
    assert sorted((r.doc_id, r.text, r.n_chars, r.ids) for r in suffix.remove_repeats(cut).collect()) == [(0, "é" + "a" * 50, 51, "x"), (1, "éx", 2, "x"), (2, None, None, "x")]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(6)
    for alphabet in (1, 2, 5):
        data = rng.integers(0, alphabet, 400).astype(np.uint8)
        text = np.concatenate([data, np.zeros(200, np.uint8)])
        order = suffix.suffix_array(text, 400)
        assert order.tolist() == sorted(range(400), key=lambda i: data[i:].tobytes())
        shared = suffix.common_prefixes(text, order, 8)
        for k in range(1, 400):
            a, b = data[order[k - 1] :], data[order[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert n >= 50 and shared[k] == 50 or shared[k] >= n


# op4


def test_pieces_equal_the_library(spark, texts):
    model = pieces.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Codec(model)
    rng = random.Random(1)
    cases = ["".join(rng.choice("ab the▁ \t\n😀é　<0x41>\x00.-_ñ中ßth") for _ in range(rng.randrange(30))) for _ in range(2000)]
    for t in [*cases, *(t or "" for t in texts)]:
        ids, starts, ends = codec.encode(t.encode())
        assert ids == library.encode(t) and codec.decode(ids) == library.decode(ids)
        assert all(a <= b for a, b in zip(starts, ends, strict=True)) and (not ids or ends[-1] == len(t.encode()))
        for unit in codec.split(codec.normalise(t.encode())[0].decode()):
            assert codec.merge(unit) == codec.units[unit] and codec._merge_short(list(unit)) == codec._merge_long(list(unit))
    for _ in range(1000):
        ids = [rng.randrange(3, 32_000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randrange(1, 9))]
        assert codec.decode(ids) == library.decode(ids)
    t = "  Héllo wörld 😀😀 x\n tail "
    got = [(i, t.encode()[a:b].decode()) for i, a, b in zip(*codec.encode(t.encode()), strict=True)]
    assert got == [(p.id, p.surface) for p in library.encode(t, return_type="proto").pieces]
    df = documents(spark, texts)
    rows = pieces.encode_documents(df, model, digest=True)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(x := library.encode(t or "")), sha(",".join(map(str, x))), sha(library.decode(x))) for i, t in enumerate(texts)]
    assert collect(rows, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert [r.ids for r in pieces.encode_documents(df.where("doc_id = 4"), model).collect()] == [library.encode(texts[4])]
    assert pieces.encode_documents(df.where("doc_id < 0"), model).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze,dummy", [(True, True), (False, True), (True, False), (False, False)])
def test_models_with_a_character_map(rule, squeeze, dummy):
    """Ids and source spans equal the library's for the same pieces under other normalisers."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, spec = pb.ModelProto(), pb.ModelProto()
    proto.ParseFromString(pieces.load_model(public_tokenizers.path("piece_bpe_32k.model")))
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = spec.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.escape_whitespaces = squeeze, dummy, True
    model = proto.SerializeToString()
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Codec(model)
    assert (codec.normalise.map is None) == (rule == "identity")
    rng = random.Random(2)
    cases = ["ﬁne　①Å é½ ｶﾞ x", "plain", "", "ﷺ!", "  two  spaces ", "Ⅷ ℌello ﬀ", "a\u200bb\u00ad c", "…\t\nend"]
    cases += ["".join(rng.choice("ab thE \t\n①ﬁ Å½ｶﾞ　é😀ß.ﷺİ") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    for t in cases:
        want = library.encode(t, return_type="proto").pieces
        ids, starts, ends = codec.encode(t.encode())
        assert ids == [p.id for p in want], t
        assert [t.encode()[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [p.surface for p in want] or squeeze, t
        assert codec.decode(ids) == library.decode(ids)


# op5


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(0, 60), None, None if i % 7 == 0 else f"s{i % 5 if rng.random() < 0.5 else 0}", 0, 1, "", "") for i in range(300)] + [(300, None, None, "s1", None, 1, "", "")] * 2
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == 302 and {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    sizes, names = Counter(), sorted({r.source for r in got}, key=lambda s: (s is None, s))
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
    target, total = {}, 1.5 * sum(sizes.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free = set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    for s in names:
        taken = sum(r.taken for r in got if r.source == s)
        assert next(r.target for r in got if r.source == s) == pytest.approx(target[s]) and abs(taken - target[s]) < 60
    assert mixing.mix(df.where("doc_id < 0")).count() == 0
    copies = Counter(r.doc_id for r in mixing.mixed_rows(df).collect())
    wanted = Counter()
    for r in got:
        wanted[r.doc_id] += r.copies
    assert copies == Counter({k: v for k, v in wanted.items() if v})


def test_mixed_rows_keep_their_decisions(spark, monkeypatch):
    """Rows of one id and of none: as many words are written as were decided."""
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(8)
    made = ["w " * rng.randrange(1, 90) + f"x{i}" for i in range(300)] + ["same words here"] * 5 + [None, ""]
    df = documents(spark, made, ids=[7 if i % 9 == 0 else None if i % 5 == 0 else i for i in range(len(made))])
    for seed in (1, 2, 3):
        rows = mixing.mixed_rows(df, seed).collect()
        judged = mixing.mix(df, seed).collect()
        assert rows[0].asDict().keys() == set(df.columns) and sum(len((r.text or "").split()) for r in rows) == sum(r.taken for r in judged)
        assert Counter((r.doc_id, len(r.text.split())) for r in rows) == Counter({k: n for r in judged for k, n in [((r.doc_id, r.size), 0)]} | dict(Counter(k for r in judged for k in [(r.doc_id, r.size)] * r.copies)))


def test_flight_keeps_totals():
    rng = random.Random(9)
    size = sorted((rng.randrange(1, 500) if rng.random() < 0.98 else 20_000 for _ in range(400)), reverse=True)
    chance = mixing.fly(size, [0.37] * 400, 1)
    left = [s for s, x in zip(size, chance, strict=True) if 0 < x < 1]
    assert len(left) <= 2 and max(left, default=0) < 20
    assert sum(chance) == pytest.approx(0.37 * 400) and sum(a * b for a, b in zip(size, chance, strict=True)) == pytest.approx(0.37 * sum(size))
    for even in ([5] * 7, [3, 3, 1], [9, 1, 1], [4, 2, 1], [1, 1, 1, 1]):
        chance = mixing.fly(even, [0.5, 0.25, 0.75, 0.5, 0.5, 0.5, 0.5][: len(even)], 3)
        assert sum(0 < x < 1 for x in chance) <= 2


def test_flight_and_landing_keep_inclusion_probabilities():
    rng = random.Random(5)
    size = sorted((rng.randrange(5, 90) for _ in range(30)), reverse=True)
    chance = [rng.choice([0.2, 0.37, 0.5, 0.8]) for _ in size]
    flights = np.array([mixing.fly(size, chance, k) for k in range(2500)])
    assert np.abs(flights.mean(axis=0) - chance).max() < 0.04
    runs = np.array([mixing.land(size, mixing.fly(size, chance, k, mixing.KEEP), k) for k in range(2500)])
    assert set(np.unique(runs)) <= {0.0, 1.0} and np.abs(runs.mean(axis=0) - chance).max() < 0.04
    off = np.abs(runs @ size - np.dot(size, chance)) / np.dot(size, chance)
    assert np.median(off) < 0.005 and off.max() < 0.05
    assert mixing.land([5], [0.0], 1).tolist() == [0.0] and mixing.land([], [], 1).tolist() == []


def test_large_documents_give_way_to_the_words():
    """Half of a source's words in one document: the words taken come near all the same."""
    size, chance = [900, 160, 150, 141, 130, 130, 112, 75, 33, 22, 9, 4], [0.8] * 12
    for k in range(50):
        assert abs(mixing.land(size, mixing.fly(size, chance, k, mixing.KEEP), k) @ size - 0.8 * sum(size)) <= 0.02 * sum(size)


def test_every_source_lands_near_its_target(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) > 10 and max(abs(r.taken - r.target) / r.target for r in got) < 0.01


# op6


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 4097])
def test_permutation(n):
    assert sorted(shards.permute(np.arange(n), n, 5).tolist()) == list(range(n))


def test_training_order(spark, texts, tmp_path):
    import base64

    import tiktoken

    vocabulary = shards.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}, special_tokens={})
    texts = [*texts, texts[9], texts[10]]
    ids = [None if i % 11 == 0 else 3 if i % 7 == 0 else i for i in range(len(texts))]
    df, small = documents(spark, texts, ids), {"length": 16, "per_shard": 8}
    manifest = shards.materialise(df, vocabulary, public_tokenizers.PATTERN, str(tmp_path / "a"), passes=3, **small).collect()
    rows = shards.read_slots(spark, str(tmp_path / "a"), **small).collect()
    want = [(-1 if i is None else i, k // 16, x[k : k + 16]) for i, t in zip(ids, texts, strict=True) for x in [encoding.encode_ordinary(t or "")] for k in range(0, len(x), 16)]
    tokens = lambda r: np.frombuffer(r.ids, "<u2").tolist()
    assert sorted((r.doc_id, r.seq, tokens(r)) for r in rows) == sorted(want)
    assert sorted(r.slot for r in rows) == list(range(len(want))) and all(r.slot == r.shard * 8 + r.offset // 49 for r in rows)
    assert sum(m.n for m in manifest) == len(want) and all(m.first_slot == 8 * m.shard and m.stride == 49 for m in manifest)
    for m in manifest:  # plain files of fixed-stride records
        (file,) = (tmp_path / "a" / f"pass={m['pass']}" / f"shard={m.shard}").glob("part-*")
        assert file.stat().st_size == 49 * m.n
    some = shards.read_slots(spark, str(tmp_path / "a"), 5, 21, **small).collect()
    assert sorted((r.slot, r.ids) for r in some) == sorted((r.slot, r.ids) for r in rows if 5 <= r.slot < 21)
    # Another layout gives the same slots; a pass that is not committed is written again, the others stay.
    shards.materialise(df.repartition(5), vocabulary, public_tokenizers.PATTERN, str(tmp_path / "b"), passes=3, **small)
    assert sorted(map(tuple, shards.read_slots(spark, str(tmp_path / "b"), **small).collect())) == sorted(map(tuple, rows))
    kept = (tmp_path / "b" / "pass=0" / "_SUCCESS").stat().st_mtime_ns
    (tmp_path / "b" / "pass=1" / "_SUCCESS").unlink()
    shards.materialise(df, vocabulary, public_tokenizers.PATTERN, str(tmp_path / "b"), passes=3, **small)
    assert sorted(map(tuple, shards.read_slots(spark, str(tmp_path / "b"), **small).collect())) == sorted(map(tuple, rows))
    assert (tmp_path / "b" / "pass=0" / "_SUCCESS").stat().st_mtime_ns == kept and (tmp_path / "b" / "pass=1" / "_SUCCESS").exists()
    assert shards.training_order(documents(spark, [None, ""]), vocabulary, public_tokenizers.PATTERN).count() == 0


# op7


def test_quality(spark, texts):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = []
    for i, t in enumerate(texts):
        t = t or ""
        w = word.findall(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if many[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if word.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    df = documents(spark, texts)
    got = quality.quality_rules(df)
    assert collect(got, "doc_id", *quality.FEATURES, "base_failed") == sorted(want, key=repr)
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert 7 not in kept and not any(w[-1] for w in want if w[0] in kept)
    assert collect(quality.keep_good(df), "doc_id", "text", "n_chars", "row") == sorted([(i, texts[i], len(texts[i]), "y") for i in kept], key=repr)
    assert quality.quality_rules(df.where("doc_id < 0")).count() == 0


def test_fences_follow_the_group(spark):
    rng = random.Random(3)
    clean = [" ".join(rng.choice(["river", "stone", "cloud", "meadow", "lantern"]) + str(rng.randrange(500)) for _ in range(80)) for _ in range(60)]
    junk = [" ".join(w + "***" for w in t.split()) for t in clean[:5]]
    df = documents(spark, clean + junk)
    kept = {r.doc_id for r in quality.quality_rules(df).where("kept").collect()}
    assert kept == set(range(60))


# op8


def test_licences(spark):
    index = licences.Index.build()
    text = "x\nLicensed under the Apache License, Version 2.0.\ny released UNDER the mit license z. This work is licensed under the GNU General Public Licence, version 3!"
    got = licences.scan(index, text.encode())
    assert [g[0] for g in got] == ["Apache-2.0", "MIT", "GPL-3.0"] and got[2][1] == 11
    assert text[got[0][3] : got[0][4]] == "Licensed under the Apache License, Version 2.0"
    for clean in ("", "licensed", "under the the under version", "The license of the poet was released under the moon."):
        assert licences.scan(index, clean.encode()) == []
    df = documents(spark, [text, None, "", text], ids=[1, 2, 3, 1])
    assert Counter(r.doc_id for r in licences.scan_licences(df).collect()) == {1: 6}
    every = licences.scan(index, "\n\n".join(licences.TEMPLATES.values()).encode())
    within = {"Apache-2.0", "MIT-grant", "BSD-3-Clause", "MPL-2.0"}  # a longer one holds them
    assert {g[0] for g in every} >= set(licences.TEMPLATES) - within


@pytest.mark.parametrize("name", licences.TEMPLATES)
def test_licences_with_one_word_changed(name):
    index = licences.Index.build()
    words = re.findall(r"[0-9a-z]+", licences.TEMPLATES[name].lower())
    places = range(0, len(words), max(1, len(words) // 25))  # every one, in short notices
    edits = [[*words[:i], *new, *words[i + cut :]] for i in places for cut, new in ((1, ["zzz"]), (1, []), (0, ["zzz"]))]
    for edit in edits:
        at = "once upon a time " + " ".join(edit) + " there lived a poet"
        assert any(g[0] == name or g[1] > licences.COVERAGE * len(words) for g in licences.scan(index, at.encode())), edit
    if name == "MIT":
        for text in ("Licensed under the MIT License.", "Released under MIT License."):
            assert [g[:3] for g in licences.scan(index, text.encode())] == [("MIT", 4, 0.8)]


def whole_alignment(template, text):
    """The best local alignment without a band: (score, matched, start, end); of equal scores the one of more words."""
    best, above = (0, 0, 0, 0), [(0, 0, -1)] * (len(text) + 1)
    for want in template:
        row = [(0, 0, -1)]
        for j, got in enumerate(text):
            s, m, at = above[j] if above[j][1] else (0, 0, j)
            ways = [(s + (2 if got == want else -2), m + (got == want), at), *((c[0] - 2, c[1], c[2]) for c in (above[j + 1], row[-1]) if c[0] > 0)]
            cell = max(ways, key=lambda x: (x[0], x[1]))
            row.append(cell if cell[0] >= 0 and cell[1] else (0, 0, -1))
            if row[-1][:2] > best[:2]:
                best = (*row[-1], j + 1)
        above = row
    return best


def test_licences_against_whole_alignment():
    """Edited notices of every length: reported where an alignment over the whole text says so, with its words and span."""
    index, rng = licences.Index.build(), random.Random(12)
    lengths = {len(t): licences.least_run(len(t)) for t in index.texts}
    assert min(lengths.values()) == 2 and max(lengths.values()) == 4 and {min(r, licences.GRAM) for r in lengths.values()} == {2, 3} == set(index.postings)
    names, reported = list(licences.TEMPLATES), 0
    for k in range(90):
        name = names[k % len(names)]
        words = re.findall(r"[0-9a-z]+", licences.TEMPLATES[name].lower())
        rate = rng.choice([0, 0.05, 0.1, 0.2])
        edit = []
        for w in words:
            if rng.random() < rate:
                edit += rng.choice([[], ["zzz"], [w, "zzz"]])
            else:
                edit.append(w)
        before, after = ([rng.choice(["once", "upon", "the", "of", "software"]) for _ in range(rng.randrange(8))] for _ in range(2))
        text = [*before, *edit, *after]
        score, matched, first, end = whole_alignment(words, text)
        hits = {g[0]: g for g in licences.scan(index, " ".join(text).encode())}
        if matched >= licences.COVERAGE * len(words) and score >= licences.DENSITY * 2 * matched:
            reported += 1
            byte = [m.span() for m in re.finditer(r"\S+", " ".join(text))]
            if name in hits:
                assert hits[name][1:] == (matched, matched / len(words), byte[first][0], byte[end - 1][1])
            else:  # it lies within a longer notice
                assert any(g[1] >= matched and g[3] <= byte[first][0] and byte[end - 1][1] <= g[4] for g in hits.values()), (name, text)
        else:
            assert name not in hits
    assert reported > 50


def plain_align(template, text, diagonal, half):
    """The band cell by cell: score, matched words, first and last+1 word of the text, words of the template spanned."""
    best, nothing, width = (0, 0, 0, 0, 0), (0, 0, -1, -1), 2 * half + 1
    above = [nothing] * (width + 1)
    for i, want in enumerate(template):
        row, left = [nothing] * (width + 1), nothing
        for b in range(width):
            j = i + diagonal + b - half
            if not 0 <= j < len(text):
                left = nothing
                continue
            hit = text[j] == want
            score, matched, start, first = above[b] if above[b][1] else (0, 0, j, i)
            options = [(score + (2 if hit else -2), matched + hit, start, first)]
            options += [(old[0] - 2, *old[1:]) for old in (above[b + 1], left) if old[0] > 0]
            left = max(options, key=lambda x: (x[0], x[1]))
            if left[0] < 0 or not left[1]:
                left = nothing
            row[b] = left
            if left[:2] > best[:2]:
                best = (left[0], left[1], left[2], j + 1, i + 1 - left[3])
        above = row
    return best


def test_banded_alignment():
    rng = random.Random(21)
    for _ in range(400):
        template = [rng.randrange(1, rng.choice([3, 8, 40])) for _ in range(rng.randrange(1, 30))]
        text = [w for w in template if rng.random() < 0.85 for w in ([w] if rng.random() < 0.9 else [rng.randrange(9), w])]
        text = [rng.randrange(9) for _ in range(rng.randrange(8))] + text + [rng.randrange(9) for _ in range(rng.randrange(8))]
        diagonal, half = rng.randrange(-5, 9), rng.randrange(0, 9)
        a, b = np.array(template), np.array(text, np.int64)
        assert licences.align(licences.banded(a, b, diagonal, half), len(b), diagonal) == plain_align(template, text, diagonal, half)


def test_repeated_licences_are_quick():
    import time

    index, words = licences.Index.build(), [f"w{i}" for i in range(50)]
    text, rng = [], random.Random(3)
    whole = [licences.TEMPLATES[n] for n in ("MIT-text", "ISC-text", "BSD-3-Clause-text", "Zlib-text")]
    while sum(map(len, text)) < 300_000:
        text += [rng.choice(whole), " ".join(rng.choice(words) for _ in range(rng.randrange(40)))]
    began = time.process_time()
    got = licences.scan(index, "\n".join(text).encode())
    assert time.process_time() - began < 30 and len(got) == sum(t in whole for t in text) and {g[2] for g in got} == {1.0}


# op9

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<!-- x --><div class="cookie-notice">We use cookies</div><div class="layout"><div id="content" class="post-17"><h1>T&eacute;st</h1><p>First <b>par</b>t<p>Second &amp;  part<br>goes on<ul><li>one<li>two</ul>
<form><input>Send</form><script>if (a < b) { "</p>" }</script><section class="comments"><p>nice</p></section></div><aside>side</aside></div><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    want = "Tést\n\nFirst part\n\nSecond & part goes on\n\none\n\ntwo"
    assert html.extract(PAGE) == want
    assert html.vote(PAGE)[0] == "html>body>div.layout>div.post-0"
    rows = [(1, "http://a.b/1", PAGE), (2, "http://a.b/2", PAGE.replace("post-17", "post-4")), (3, None, None), (4, "x", ""), (5, "http://a.b/3", "<p>bare &lt; text"), (5, "http://a.b/3", "<p>bare &lt; text"), (6, "http://c/", "a < b <broken")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, path string")
    got = collect(html.main_texts(df), "page_id", "url", "text", "n_chars")
    assert got == sorted([(1, "http://a.b/1", want, len(want)), (2, "http://a.b/2", want, len(want)), (3, None, "", 0), (4, "x", "", 0), *[(5, "http://a.b/3", "bare < text", 11)] * 2, (6, "http://c/", "a < b", 5)], key=repr)
    assert html.main_texts(df.where("page_id < 0")).count() == 0
    assert html.extract("<div>" * 3000 + "deep" + html_lib.escape(" & ") + "x") == "deep & x"


def test_deep_and_odd_pages(spark):
    deep, item = "<div class=a>" * 5000 + "deep" + "</div>", "<ul>" + "<li><td>" * 3000 + "end" + "<b>" * 4000 + "</i>" * 4000
    rows = [(1, "http://d.e/", deep), (2, "http://d.e/", deep), (3, "http://i.e/", item)]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "deep", 2: "deep", 3: "end"}
    assert html.vote(deep)[0].count(">") == 4999 and html.extract(deep, html.vote(deep)[0]) == "deep"


def test_hosts_outvote_a_page(spark):
    """A page whose longest container is another than its host's: the host's path wins; a page without it is read by itself."""
    say = lambda n: " ".join(f"w{i}" for i in range(n))
    page = lambda story, other: f"<body><div class='story-{len(story)}'><p>{story}</p></div><div class='info'><p>{other}</p></div></body>"
    rows = [(i, f"http://a.b/{i}", page(say(90 + i), "short")) for i in range(6)] + [(6, "http://a.b/6", page("brief story", say(80))), (7, "http://c.d/", page("brief story", say(80))), (8, "http://a.b/8", f"<body><div class='solo'>{say(20)}</div></body>")]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[6] == "brief story" and got[7] == say(80) and got[8] == say(20) and got[0] == say(90)
    assert {r.host: r.path for r in html.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"a.b": "body>div.story-0", "c.d": "body>div.info"}


def test_layout_words_are_no_noise():
    story = "<article><header class='entry-header'><h1>Title</h1></header><p>The story itself.</p></article>"
    for name in ("has-sidebar", "no-sidebar", "overflow-hidden", "long-form", "page header-dark", "widget-area"):
        assert html.extract(f"<body><div class='{name}'>{story}</div></body>") == "Title\n\nThe story itself."
    for name in ("sidebar", "cookie-notice", "comments", "site-footer"):
        assert html.extract(f"<body>{story}<div class='{name}'><p>Other words, many more of them than the story has, again and again and again.</p></div></body>") == "Title\n\nThe story itself."
    assert html.extract(f"<body>{story}<div class='comments'><article><h1>Re</h1><p>{'So much to say. ' * 30}</p></article></div></body>") == "Title\n\nThe story itself."


def test_comments_are_no_story():
    """Reader comments in article elements go, marked by class, role or item type, nested or beside the story, however long."""
    story, long = "<h1>T</h1><p>Body of the story, some words of it.</p>", f"<p>{'So much to say about this. ' * 40}</p>"
    want = "T\n\nBody of the story, some words of it."
    for mark in ("class='comment'", "class='comment-body depth-2'", "class='user-comment'", "role='comment'", "itemprop='comment'", "itemtype='https://schema.org/Comment'", "id='comment-17'", "class=reply"):
        remark = f"<article {mark}>{long}</article>"
        for page in (f"<main>{story}{remark}{remark}</main>", f"<article>{story}{remark}</article>", f"<main><article>{story}</article>{remark}</main>", f"<div>{story}{remark}</div>", f"<article>{story}<article {mark}><h1>Re</h1>{long}{remark}</article></article>"):
            assert html.extract(f"<body>{page}</body>") == want, (mark, page[:60])
    for name in ("post comments-open", "no-comments", "has-comments", "post"):
        assert html.extract(f"<body><article class='{name}'>{story}</article></body>") == want
    assert html.extract(f"<body><main>{story}<section id='comments'><article>{long}</article><article>{long}</article></section></main></body>") == want
    nested = html.extract(f"<body><article>{story}<article>{long}</article></article></body>")
    assert nested.startswith(want)  # an unmarked inner article is no better than the one around it


LABELLED = [
    ("<div id=wrap><header>Site</header><div class=post><h2>A</h2><p>One two three four five.</p><p>Six seven eight.</p></div><div class=sidebar><p>Links and more links and still more links.</p></div></div>", "A\n\nOne two three four five.\n\nSix seven eight."),
    ("<main><article><h1>A</h1><p>One two three.</p><figure><img><figcaption>Fig</figcaption></figure><p>Four.</p></article><aside><p>Related things to read right now</p></aside></main>", "A\n\nOne two three.\n\nFig\n\nFour."),
    ("<table><tr><td class=nav><a href=/>Home</a></td><td><p>One two three four.</p><p>Five six.</p></td></tr></table>", "One two three four.\n\nFive six."),
    ("<article><p>One two.</p><ol><li>a<li>b</ol><blockquote>said</blockquote><pre>x  y</pre></article><footer>end</footer>", "One two.\n\na\n\nb\n\nsaid\n\nx y"),
    ("<div class=content><p>One&nbsp;two &#8212; three.</p><div class=ad>Buy now</div><p>Four<sup>2</sup></p></div><div class=comments><p>Nice one, thank you for it all.</p></div>", "One two \u2014 three.\n\nFour2"),
]


@pytest.mark.parametrize(("page", "want"), LABELLED)
def test_labelled_pages(page, want):
    assert html.extract(f"<!doctype html><html><head><title>t</title></head><body>{page}</body></html>") == want


# op10


def test_urls(spark):
    link = '<head><link rel="canonical" href="{}"></head>'
    rows = [
        (1, "https://A.net/x", None), (2, "http://example.net/en/a?q#f", ""), (3, "http://sub.example.net/EN/a", ""), (4, "http://www.example.com/de/", ""), (5, "http://example.com/de", ""),
        (6, "http://ok.org/x", link.format("https://bad.net/y")), (7, "http://ok.org/z", '<META http-equiv=refresh content="0; url=/x">'), (8, "http://ok.org/fr/x", link.format("http://bad.net/y")),
        (9, "http://free.org/a", link.format("http://example.net/en/b")), (10, "http://free.org/b", link.format("http://free.org/a") + link.format("http://bad2.net/")),
        (11, None, link.format("http://bad.net/y")), (12, "no scheme", ""), (13, "http://xnet/", ""), (14, "http://ok.org/x", ""), (14, "http://ok.org/x", ""), (15, "://", ""),
    ]
    df = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("example.net", "/en/a", "example.net/en/", "allow"), 3: ("sub.example.net", "/EN/a", "net/", "block"), 4: ("www.example.com", "/de/", "example.com/de/", "block"),
        5: ("example.com", "/de", None, "allow"), 6: ("ok.org", "/x", None, "allow"), 7: ("ok.org", "/z", None, "allow"), 8: ("ok.org", "/fr/x", "org/fr/", "allow"), 9: ("free.org", "/a", None, "allow"),
        10: ("free.org", "/b", None, "allow"), 11: ("", "", None, "allow"), 12: ("", "", None, "allow"), 13: ("xnet", "/", None, "allow"), 14: ("ok.org", "/x", None, "allow"), 15: ("", "", None, "allow"),
    }
    assert plain_verdicts(df) == collect(urls.judge_urls(df), "page_id", "host", "path", "rule", "verdict")
    lone = df.where("page_id in (6, 7, 14)")
    assert {r.page_id: r.verdict for r in urls.judge_urls(lone).collect()} == {6: "block", 7: "block", 14: "block"}
    assert urls.judge_urls(df.where("page_id < 0")).count() == 0


def plain_verdicts(df):
    """What the SQL for the test data's pages, which hold no links, says of others."""
    import duckdb
    import pyarrow as pa

    from treeloom.llm import oracles

    with duckdb.connect() as db:
        db.register("pages", pa.Table.from_pylist([{k: r[k] for k in ("page_id", "url", "html")} for r in df.collect()], pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])))
        return sorted(db.sql(oracles.OP10).fetchall(), key=repr)


def test_linked_pages(spark):
    """Canonical links and refreshes of every form, in chains and rings, against SQL."""
    rng = random.Random(6)
    hosts = ["a.net", "example.net", "www.example.com", "b.org", "c.io", "D.io", "e.de"]
    paths = ["", "/", "/en/x{}", "/de/y{}?q=1", "/fr/z{}#top", "/p/q/r{}.html", "/en{}", "/w{}"]
    there = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths).format(rng.randrange(40))}"
    links = [
        lambda: f'<link rel="canonical" href="{there()}">', lambda: f"<LINK href='{there()}' REL=Canonical />", lambda: f'<link rel=canonical href={rng.choice(["/en/", "up.html", "../x", "?k=2", "#only", "//c.io/w"])}>',
        lambda: f'<meta http-equiv="Refresh" content="0; URL={there()}">', lambda: f"<meta content='5;url=\"{there()}\"' http-equiv='refresh'>", lambda: '<link rel="stylesheet" href="http://a.net/s.css">', lambda: "<p>canonical http-equiv</p>", lambda: "",
    ]
    rows = [(i, there() if rng.random() < 0.95 else rng.choice([None, "none", "://"]), rng.choice([None, *(rng.choice(links)() + rng.choice(links)() for _ in range(9))])) for i in range(150)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, rule string, host string")
    got = urls.judge_urls(df)
    assert collect(got, "page_id", "host", "path", "rule", "verdict") == plain_verdicts(df)
    assert 3 < got.where("by_alias").count() < 100


def test_pages_of_any_size(spark):
    """Long unquoted values and thousands of attributes end nothing; tags in comments, scripts and other values are none."""
    block = 'http://bad.net/y'
    link = f'<link rel="canonical" href="{block}">'
    rows = [
        (0, "http://a.org/0", f"<link rel=icon href=data:image/png;base64,{'A' * 1_000_000}>" + link), (1, "http://a.org/1", "<meta " + "a='b\"c' " * 5000 + ">" + link), (2, "http://a.org/2", f"<!-- {link} -->"), (3, "http://a.org/3", f"<script>var x = '{link}'</script>"),
        (4, "http://a.org/4", f"<!-- open {link}"), (5, "http://a.org/5", f"<textarea>{link}</textarea>{link.upper().replace(block.upper(), block)}"), (6, "http://a.org/6", f"<link title=' rel=\"canonical\"' href='{block}'>"), (7, "http://a.org/7", f"<link rel=canonical rel=icon href={block} href=/x>"),
        (8, "http://a.org/8", "canonical " + "<link " * 100_000), (9, "http://a.org/9", "<!--x" * 50_000 + link + "canonical"), (10, "http://a.org/10", "<meta http-equiv=refresh content=" + "x" * 500_000 + ">" + link), (11, "http://a.org/11", '"' * 300_000 + link),
        (12, "http://a.org/12", "<link " + '"' * 200_001 + " canonical>"), (13, "http://a.org/13", "<scripty>" + link), (14, "http://a.org/14", f"<SCRIPT>a</script >{link}"), (15, "http://a.org/15", f"<style>{link}"), (16, "http://a.org/16", f"<link\nrel\n=\n'canonical'\nhref\n=\n'{block}'\n/>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(df).collect()}
    assert {k for k, v in got.items() if v == "block"} == {0, 1, 5, 7, 10, 11, 13, 14, 16}
    assert plain_verdicts(df) == collect(urls.judge_urls(df), "page_id", "host", "path", "rule", "verdict")


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [say(rng.randrange(80, 160)) for _ in range(60)]
    shared = say(55)
    made = [*clean, clean[3], clean[4], "short", None, " ".join(["again and again"] * 40), *[" ".join(w + "$$$" for w in clean[0].split())], say(60) + " " + shared, say(60) + " " + shared]
    documents(spark, made).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, step in corpus_pipeline.STAGES:
        docs = common.stage(step(spark, docs, str(tmp_path)), f"test-{name}").df
        kept[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: [r.doc_id for r in v] for k, v in kept.items()}
    assert sorted(ids["quality"]) == [*range(62), 66, 67]
    assert sorted(ids["near_duplicates"]) == [*range(60), 66, 67]
    by_id = {r.doc_id: r for r in kept["repeats"]}
    assert shared in by_id[66].text and shared not in by_id[67].text and all(by_id[i].text == clean[i] for i in range(60)) and by_id[67].n_chars == len(by_id[67].text)
    assert Counter(ids["mixture"]) == Counter(ids["encoding"]) and max(Counter(ids["mixture"]).values()) == 2
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(ids["encoding"])


def test_stages_release_what_was_written(spark, tmp_path):
    """What a stage staged goes once another reads its written rows, not while it is read from, nor for the same stage or documents."""
    import corpus_pipeline

    rng = random.Random(14)
    made = [" ".join(f"w{rng.randrange(3000)}" for _ in range(90)) for _ in range(30)]
    documents(spark, [*made, made[0], "short"]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    good, again = corpus_pipeline.quality(spark, df, ""), corpus_pipeline.quality(spark, df, "")
    chained, beside = corpus_pipeline.near_duplicates(spark, good, ""), corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(r.doc_id for r in chained.collect()) == list(range(30)) and beside.count() == 31
    assert good.count() == again.count() == 31
    held = [x.path for name, _, x in corpus_pipeline._EARLIER if name == "quality"]
    good.write.parquet(str(tmp_path / "good"))
    corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "good")), "")
    assert held and not any(common.exists(spark, p) for p in held)


def test_pipeline_on_odd_tables(spark):
    """Null, empty, repeated and clashing: no stage fails, and each gives what its docstring says."""
    import corpus_pipeline

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (4, texts[5][::-1] + " x" * 60), (None, texts[6]), (None, texts[6]), (None, None), (50, None), (51, ""), (52, " \n"), (53, texts[7] + " é" * 9000)]
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, node int, fp string, size int, key string, _id int, component string, _text string, rid int"
    made = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "a", None, "r", 1, "f", 2, "k", 3, "c", "t", 4) for k, (i, t) in enumerate(rows)]
    docs, empty = spark.createDataFrame(made, names), spark.createDataFrame([], names)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, "")
        got = out.collect()
        assert step(spark, empty, "").count() == 0 and (name == "encoding" or out.schema.names == docs.schema.names)
        if name != "encoding":
            assert all((r.row, r.node, r.fp, r.size, r.key, r._id, r.component, r._text, r.rid) == ("r", 1, "f", 2, "k", 3, "c", "t", 4) for r in got)
        ids = Counter(r.doc_id for r in got)
        if name == "quality":
            assert ids.keys() >= set(range(20)) and not ids.keys() & {50, 51, 52}
        elif name == "near_duplicates":
            assert all(ids[i] == 1 for i in range(20) if i != 4) and ids[4] == 2 and ids[None] == 3 and ids[50] == 1 and not ids.keys() & {51, 52}
        elif name == "repeats":
            assert len(got) == len(rows) and sum(r.text is None for r in got) == 2
        elif name == "mixture":
            assert not ids.keys() & {50, 51, 52}
        else:
            assert len(got) == len(rows) and sum(r.n_tokens == 0 for r in got) == 3
