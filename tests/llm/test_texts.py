"""Token alignment, ranked search and the compression classifier against plain versions."""

import hashlib
import math
import re
import threading
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tsmeter.llm import align, compress, search
from tsmeter.llm.queries import op12_ranked_search, op13_quality_classifier

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# -- alignment ---------------------------------------------------------------------------------

ODD_TEXTS = [
    None, "", " ", "  ", "a ▁b", "▁", "a\n\n b  c", "é 日本語 テキスト 😀😀 x", "<|endoftext|> <s> x </s> <unk>", "tab\t x \xa0 y \x85 z", "\x00 x \x1c y", "x" * 3000, "a  b   c", " lead", "trail ", "　 w 　", "naïve 'll we 've x's 's",
    "İ ǆ ß ﬁ", "12 345 6", "it's  'twas\n\n\n\n x", "😀" * 500, "Ω≈ç√ ∫˜µ", "\r\n x \r y", "a " * 300, "  a   b   c",
]


def brute_alignment(texts):
    """Each text's tokens by the public files, in groups between common byte ends."""
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {}  # the byte-level alphabet: printable bytes are themselves
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of.update({chr(b): b for b in shown})
    byte_of.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})
    spell_a = lambda i: bytes(byte_of[c] for c in bpe.id_to_token(i))

    def spell_b(i):
        p = piece.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    out = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = bpe.encode(" " + text, add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        if b"".join(map(spell_a, a)) != whole or b"".join(map(spell_b, b)) != whole:
            a, b = [], []
        groups, i, j, at_a, at_b, own_a, own_b = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                at_a += len(spell_a(a[i]))
                own_a.append(a[i])
                i += 1
            else:
                at_b += len(spell_b(b[j]))
                own_b.append(b[j])
                j += 1
            if at_a == at_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        assert not own_a and not own_b
        out.append(groups)
    return out


def brute_digest(texts):
    aligned = brute_alignment(texts)
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in aligned]
    count = Counter(pair for own in links for pair in own)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for groups, own in zip(aligned, links):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        rows.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), own.total(), sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [1 << 20, 300, 0])
def test_alignment_equals_brute_force(spark, documents, hot):
    texts = ODD_TEXTS + [r["text"] for r in documents.orderBy("doc_id").limit(60).collect()]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.cross_align(docs, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_digest(texts)


def test_alignment_groups(spark):
    texts = [t for t in ODD_TEXTS]
    rows = align.alignments(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    for r, groups in zip(rows, brute_alignment(texts)):
        assert r["a"] == [x for a, _ in groups for x in a] and r["b"] == [x for _, b in groups for x in b]
        assert r["a_group"] == [k for k, (a, _) in enumerate(groups) for _ in a] and r["b_group"] == [k for k, (_, b) in enumerate(groups) for _ in b]


def test_large_groups_are_added_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 400), rng.integers(0, 40, 300)
    x = align.Aligned(a, b, np.repeat([0, 1, 2], [250, 100, 50]), np.repeat([0, 1, 2], [200, 60, 40]), np.array([0, 250, 400]), np.array([0, 200, 300]), np.array([0, 1, 3]))
    expected = Counter()
    for g, d in ((0, 0), (1, 1), (2, 1)):
        expected.update((d << 32 | int(p) << 16 | int(q)) for p in a[x.group_a == g] for q in b[x.group_b == g])
    for block in (1 << 21, 5000, 100, 7):
        monkeypatch.setattr(align, "BLOCK", block)
        key, n = align.linked(x, 16)
        assert dict(zip(key.tolist(), n.tolist())) == expected


def test_alignment_of_odd_tables(spark, odd, empty):
    got = align.cross_align(odd).collect()
    assert len(got) == odd.count()
    assert {r["n_a"] for r in got if r["doc_id"] in (9001, 9002)} == {0}
    assert align.cross_align(empty).count() == 0 and align.alignments(empty).count() == 0
    ids = spark.createDataFrame([(None, "a b c", "en", "s", 0), (None, "a b c", "en", "s", 0)], SCHEMA)
    assert [r["count_sum"] for r in align.cross_align(ids).collect()] == [6, 6]


# -- search ------------------------------------------------------------------------------------


def brute_search(docs, items, top=10):
    found = [(i, Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for i, t in docs]
    big_n, big_l = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        query = Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scores = []
        for doc, c in found:
            score = 0
            for t, k in query.items():
                if c[t]:
                    m = 25 + (75 * c.total() * big_n) // big_l
                    score += k * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, k + 1, doc, -score) for k, (score, _, doc) in enumerate(sorted(scores, key=lambda s: s[:2] + (s[2] or 0,))[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 20), (500, 40), (1, 1)])
def test_search_equals_brute_force(spark, documents, shard, block):
    docs = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").limit(80).collect()]
    docs += [(1000 + i, "Über ABC abc x1 Ünique") for i in range(15)] + [(None, "abc"), (None, "abc"), (2000, None), (2001, ""), (2002, " .,- "), (2003, "abc " * 5000), (2003, "naïve 日本 x")]
    items = [(1, docs[0][1]), (2, "abc ABC über"), (3, None), (4, ""), (5, "nowhere-found"), (6, "日本 x1"), (6, "abc"), (None, "ünique")]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA).repartition(3)
    got = search.search(table, spark.createDataFrame(items, "item_id long, text string"), shard=shard, block=block)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_search(docs, items)


def test_best_is_tie_safe():
    rng = np.random.default_rng(0)
    for _ in range(200):
        score, ids = rng.integers(-1, 4, 30), rng.permutation(30)
        want = sorted((i for i in range(30) if score[i] > 0), key=lambda i: (-score[i], ids[i]))[:5]
        assert search.best(score, ids, 5).tolist() == want


def test_search_of_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "word one")], "item_id long, text string").withColumn("rank", F.lit(1)).withColumn("doc_id", F.lit(1))
    found = search.search(odd, items).collect()
    assert {r["doc_id"] for r in found[:3]} <= {9004, 9007} | {r["doc_id"] for r in found} and len(found) >= 3
    assert search.search(empty, items).count() == 0
    assert search.search(odd, items.limit(0)).count() == 0


def test_index_of_one_task_is_cut_into_groups(spark):
    """A task holds a few shards at a time: no row group or page has more, however much one task wrote."""
    rng = np.random.default_rng(7)
    texts = [" ".join(re.findall("." * 8, rng.bytes(1 << 20).hex())) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    index, n_docs = search.build(docs)
    files = [f.removeprefix("file:") for f in index.inputFiles()]
    groups = [meta.row_group(g) for meta in (pq.ParquetFile(f).metadata for f in files) for g in range(meta.num_row_groups)]
    assert n_docs == 12 and len(files) == 1 and index.count() == sum(g.num_rows for g in groups) >= 12
    assert max(g.total_byte_size for g in groups) <= 12 << 20
    word = texts[5][:8]
    found = search.search(docs, spark.createDataFrame([(1, word)], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in found] == [i for i, t in enumerate(texts) if word in t.split(" ")]


def test_row_groups_are_not_read_into_direct_buffers(spark, tmp_path, monkeypatch):
    texts = [np.random.default_rng(i).bytes(1 << 20).hex() for i in range(32)]
    table = pa.table({"doc_id": pa.array(range(32), pa.int64()), "text": texts})
    pq.write_table(table, tmp_path / "documents.parquet", compression="none", use_dictionary=False)
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": ["a"]}), tmp_path / "benchmark.parquet")
    factory, direct = spark._jvm.java.lang.management.ManagementFactory, []
    bean = spark._jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")
    pool = next(b for b in factory.getPlatformMXBeans(bean) if b.getName() == "direct")
    done = threading.Event()

    def watch():
        while not done.wait(0.01):
            direct.append(pool.getMemoryUsed())

    monkeypatch.setattr(search, "search", lambda docs, items: search.lengths(docs))
    before, watcher = pool.getMemoryUsed(), threading.Thread(target=watch)
    watcher.start()
    try:
        assert op12_ranked_search(spark, str(tmp_path))[0] == 32
    finally:
        done.set()
        watcher.join()
    assert max(direct) - before < 16 << 20  # the row group has 64 MB


# -- classifier --------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark, small):
    path = small.replace("0.001", "0.01")
    got = op13_quality_classifier(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", "quality").toPandas()
    bad, good = got[got.quality == 0], got[got.quality == 1]
    assert len(bad) >= 10 and (bad.predicted == 0).mean() >= 0.8 and (good.predicted == 1).mean() >= 0.98
    assert ((got.score - got.quality) ** 2).mean() < 0.03


def test_classifier_scores_whole_texts(spark):
    """A dictionary text's words score alike wherever they stand, and all pieces count."""
    rng = np.random.default_rng(3)
    words = [["".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(400)] for letters in ("aeilmnorst", "AQ@$%XZ!#9")]
    good, bad = ([" ".join(rng.choice(own, 40)) for _ in range(300)] for own in words)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(good + bad)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    model = compress.train(docs, labels)
    assert isinstance(model, compress.Model)
    sizes = compress.Sizes(model.good, model.bad)
    first, half, last, reverse = model.scores(sizes.features([" ".join(good), " ".join(good) + " ".join(bad), " ".join(bad), " ".join(bad) + " ".join(good)]))
    assert first > 0.9 and last < 0.1 and first > half > last and first > reverse > last
    raw = ("ab" * 5000).encode()
    assert b"".join(compress.pieces_of("ab" * 5000)) == raw and compress.pieces_of("") == [b""]
    again = compress.train(docs.repartition(7), labels.repartition(3))
    assert again.good == model.good and np.array_equal(again.weights, model.weights)


def test_classifier_of_odd_tables(spark, odd, empty, labels):
    got = compress.classify(odd, labels)
    assert got.count() == odd.count() and got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert len({r["score"] for r in got.filter("doc_id in (9001, 9002)").collect()}) == 1
    assert compress.classify(empty, labels).count() == 0
    none = labels.limit(0)
    assert {r["score"] for r in compress.classify(odd, none).collect()} == {0.5}
    clashing = spark.createDataFrame([(None, None, None, 1), (3, 1, 0, 2)], "doc_id long, quality int, toxic int, text int")
    assert {round(r["score"], 3) for r in compress.classify(odd, clashing).collect()} <= {0.5, 0.667}
