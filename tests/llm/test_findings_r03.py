"""What the third round's findings on the training-data operators ask for."""

import random

import public_tokenizers
import sentencepiece

from treeloom.llm import pieces, simhash


def test_new_units_merge_together_and_frequent_ones_are_kept(monkeypatch):
    """op4: units of several texts are merged as rows, not one by one, and filling up forgets none that is asked for again."""
    model = pieces.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Codec(model)
    monkeypatch.setattr(pieces.Units, "BOUND", 400)
    monkeypatch.setattr(pieces, "ROWS", 64)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeinorstthdlé.中😀x\n") for _ in range(rng.randrange(1, 60)))
    texts = ["  ".join([*(word() for _ in range(rng.randrange(60))), "frequent"]) for _ in range(100)] + ["", " ", "\n", "x" * 500]
    alone = []
    merge = codec.merge
    monkeypatch.setattr(codec, "merge", lambda unit: (alone.append(unit), merge(unit))[1])
    got = [ids.tolist() for at in range(0, len(texts), 10) for ids, _ in codec.encode_arrays([t.encode() for t in texts[at : at + 10]])]
    assert got == [library.encode(t) for t in texts]
    assert pieces.MARK + "frequent" not in alone and len(codec.units) <= 400 and len(codec.units.older) <= 400
    rows = codec.plain({u for t in texts for u in codec.split(codec.normalise(t.encode())[0].decode())})
    assert len(rows) > 200 and codec.merge_rows(rows) == [merge(u) for u in rows]


def test_near_copies_make_no_square_of_candidates(spark, monkeypatch):
    """pipeline: a large group of near copies under ordinary keys makes no more candidate rows than it has keys, and loses no link."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    made = [" ".join(f"v{rng.randrange(4000)}" if rng.random() < 0.02 else w for w in base) for _ in range(200)]
    monkeypatch.setattr(simhash, "HEAVY", 1000)
    pairs, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda x, *more: (pairs.append(x.count()), verified(x, *more))[1])
    kind = simhash.similar(len(made))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, kind).collect()}
    sets, group = [simhash.shingles(t.encode(), kind.shingle) for t in made], list(range(len(made)))
    close = [(i, j) for j in range(len(made)) for i in range(j) if simhash.alike(sets[i], sets[j], kind.similarity)]
    for i, j in close:
        low, high = sorted((group[i], group[j]))
        group = [low if g == high else g for g in group]
    assert got == dict(enumerate(group)) and 1000 < len(close) < len(made) * (len(made) - 1) / 4
    assert sum(pairs) <= len(made) * kind.parts  # 15,000 of the 19,900 pairs there are, when each was a row
