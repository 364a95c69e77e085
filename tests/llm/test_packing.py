import random

from weftline.llm.packing import SumOfSquares, pack_documents, pack_items, packing_summary


def test_least_change_of_squares():
    random.seed(1)
    packer = SumOfSquares(20)
    for _ in range(300):
        size = random.randint(1, 20)
        before = packer.levels.copy()
        options = {}
        for h in range(0, 21 - size):
            if h and not before[h]:
                continue
            n = before.copy()
            if h:
                n[h] -= 1
            if h + size < 20:
                n[h + size] += 1
            options[h] = int((n**2).sum())
        packer.place(size)
        assert int((packer.levels**2).sum()) == min(options.values())


def test_no_container_overflows():
    random.seed(2)
    sizes = sorted((random.randint(0, 100) for _ in range(2000)), reverse=True)
    bins = pack_items(sizes, 128)
    fill = {}
    for b, s in zip(bins, sizes):
        fill[b] = fill.get(b, 0) + s
    assert max(fill.values()) <= 128 and len(fill) <= 1.02 * sum(sizes) / 128 + 1


def test_every_document_once(spark):
    random.seed(3)
    sizes = [(i, random.choice([0, 1, 5, 60, 64, 65, 200, 640, None])) for i in range(500)]
    docs = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    kinds = spark.createDataFrame([("s", "t", 64), ("l", "t", 512), ("none", "t", None)], "container_kind string, tokenizer string, capacity_tokens int")
    packed = pack_documents(docs, kinds, group_items=100)
    rows = packed.collect()
    for kind, cap in (("s", 64), ("l", 512)):
        own = [r for r in rows if r.container_kind == kind]
        fill, pieces = {}, {}
        for r in own:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
        assert max(fill.values()) <= cap
        assert set(pieces) == {d for d, _ in sizes}
        for d, n in sizes:
            got = sorted(pieces[d])
            assert sum(x for _, x in got) == (n or 0) and [p for p, _ in got] == list(range(len(got)))
            assert len(got) == (1 if (n or 0) <= cap else -(-n // cap))
    assert {r.container_kind: r.n_documents for r in packing_summary(packed, kinds).collect()} == {"s": 500, "l": 500}


def test_nothing_to_pack(spark):
    docs = spark.createDataFrame([], "doc_id long, n_tokens long")
    kinds = spark.createDataFrame([("s", "t", 64)], "container_kind string, tokenizer string, capacity_tokens int")
    assert pack_documents(docs, kinds).count() == 0
