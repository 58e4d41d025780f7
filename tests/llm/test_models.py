"""Segmentation sampling, shards, language-model scores and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tsmeter.llm import lm_score, order, secrets, similar, sp_sampling, toxicity
from tsmeter.llm.common import shared_path


def rows(df):
    return [r.asDict() for r in df.collect()]


# -- segmentations -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sp_sampling.pieces_of(None)


def all_segmentations(word, pieces):
    """ids of a segmentation: log-probability."""
    out = {}
    vocabulary = {pieces.bytes[i].decode().replace(" ", "▁"): (i, w) for i, w in zip(pieces.piece.tolist(), pieces.weight.tolist()) if i >= 0}

    def go(at, ids, weight):
        if at == len(word):
            out[tuple(ids)] = weight
            return
        single = False
        for to in range(at + 1, len(word) + 1):
            if word[at:to] in vocabulary:
                single |= to == at + 1
                i, w = vocabulary[word[at:to]]
                go(to, [*ids, i], weight + w)
        if not single:
            own = [pieces.byte_ids[b] for b in word[at].encode()]
            go(at + 1, ids + own, weight + pieces.byte_weight * len(own))

    go(0, [], 0.0)
    total = math.log(sum(math.exp(w) for w in out.values()))
    return {k: v - total for k, v in out.items()}


@pytest.mark.parametrize("text", ["abc", "a b", "the 日", "ing"])
def test_samples_without_replacement(pieces, text):
    exact = all_segmentations("▁" + text.replace(" ", "▁"), pieces)
    n, k = 3000, 3
    seeds = sp_sampling.row_seeds(list(range(n)), 5)
    got = sp_sampling.sample_batch([text] * n, seeds, k, pieces)
    first, second = Counter(), Counter()
    for found, left in got:
        ids = [tuple(x[0].tolist()) for x in found]
        assert len(set(ids)) == len(ids) == min(k, len(exact))
        assert all(x[1] == pytest.approx(exact[i], abs=1e-9) for x, i in zip(found, ids))
        values = [x[2] for x in found]
        assert values == sorted(values, reverse=True) and (left < values[-1])
        first[ids[0]] += 1
        second.update(ids[1:2])
    p = {s: math.exp(v) for s, v in exact.items()}
    for s, share in p.items():  # first: by probability; second: by what was left
        assert abs(first[s] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-3
        if len(exact) > 1:
            then = sum(q * share / (1 - q) for o, q in p.items() if o != s)
            assert abs(second[s] / n - then) < 5 * math.sqrt(then * (1 - then) / n) + 2e-3
    if len(exact) > k:  # inverse inclusion scores estimate the number of segmentations' total probability
        estimate = np.mean([sum(math.exp(x[1]) / -math.expm1(-math.exp(x[1] - left)) for x in found) for found, left in got])
        assert estimate == pytest.approx(1.0, abs=0.08)


def test_encoding_round_trip(odd):
    out = rows(sp_sampling.encode_samples(odd, with_ids=True))
    by = {}
    for r in out:
        by.setdefault((r["doc_id"], r["ids_crc32"]), []).append(r)
        assert r["round_trip"] and r["n_pieces"] == len(r["ids"]) and r["log_inclusion"] <= 0
    n = Counter(r.doc_id for r in odd.select("doc_id").collect())
    for d in n:
        own = [r for r in out if r["doc_id"] == d]
        assert len(own) >= n[d] and len({tuple(r["ids"]) for r in own}) == len(own) // n[d]
    texts = {(r.doc_id): r.text or "" for r in odd.select("doc_id", "text").collect()}
    for r in sp_sampling.decode(sp_sampling.encode_samples(odd.filter("doc_id > 9000"), with_ids=True)).collect():
        assert r.text == texts[r.doc_id]


def test_texts_that_hold_the_space_mark_come_back(spark):
    texts = {1: "a \u2581 b\u2581c", 2: "\u2581", 3: "\u2581\u2581 x  y ", 4: None, 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    encoded = sp_sampling.encode_samples(docs, with_ids=True)
    assert all(r["round_trip"] for r in rows(encoded)) and encoded.select("doc_id").distinct().count() == 5
    assert all(r.text == (texts[r.doc_id] or "") for r in sp_sampling.decode(encoded).collect())
    assert sp_sampling.encode_samples(docs.limit(0)).count() == 0


def test_units_are_words_with_the_spaces_before_them(pieces):
    """The short way for single spaces and the pattern for others cut alike; a text without words has one segmentation."""
    for text in ["", " ", "  ", "a", "a b", " a b", "a b ", "a  b c", "\u2581 a\u2581b", "x\ny \t z", "日本 語"]:
        marked = "\u2581" + text.replace("\u2581", sp_sampling.OWN_SPACE).replace(" ", "\u2581") if text else ""
        assert sp_sampling.units_of(text) == re.findall("\u2581*[^\u2581]+|\u2581+", marked)
    assert [len(found) for found, _ in sp_sampling.sample_batch(["", ""], sp_sampling.row_seeds([1, 2], 5), 3, pieces)] == [1, 1]
    plain, raw = sp_sampling.Walk(["\u2581ab"], pieces), sp_sampling.Walk(["\u2581a\U0001f9ff"], pieces)  # no character, and one, that becomes bytes
    assert pieces.decode(plain.path_ids(plain.run(plain.first, np.array([3], np.uint64), np.zeros(1, np.int64))[1])) == "ab"
    assert pieces.decode(raw.path_ids(raw.run(raw.first, np.array([3], np.uint64), np.zeros(1, np.int64))[1])) == "a\U0001f9ff"


def test_samples_do_not_depend_on_partitions(odd):
    key = lambda df: sorted((r["doc_id"], r["sample"], r["ids_crc32"], r["perturbed"]) for r in rows(df))
    assert key(sp_sampling.encode_samples(odd.repartition(7))) == key(sp_sampling.encode_samples(odd.coalesce(1)))


def test_best_encoding_decodes(odd, pieces):
    texts = {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").collect()}
    assert all(pieces.decode(r.ids) == texts[r.doc_id] or r.doc_id > 9000 for r in sp_sampling.encode_best(odd).collect())


# -- shards ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_a_bijection(n):
    a, b = order.permute(np.arange(n), n, 1), order.permute(np.arange(n), n, 2)
    assert sorted(a) == list(range(n)) == sorted(b) and (n < 64 or (a != b).any())
    assert n < 1000 or abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.1


def test_shards(spark, odd):
    path = shared_path(spark, "test-shards")
    out = order.materialise(odd, path, length=128, shard=50).toPandas().sort_values("slot")
    n = len(out)
    assert out["slot"].tolist() == list(range(n)) and sorted(out["sequence"]) == list(range(n))
    data = np.stack(list(order.read(path)))
    assert [zlib.crc32(x.tobytes()) for x in data] == out["ids_crc32"].tolist()
    assert (np.stack(list(order.read(path, 37, 137))) == data[37:137]).all()
    assert order.manifest(path)["sequences"] == n and order.manifest(path)["length"] == 128
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, order.END]) for r in odd.select("text").collect())
    flat = np.concatenate([data[s][:k] for s, k in out.sort_values("sequence")[["slot", "n_tokens"]].to_numpy()])
    total = sum(len(t) * k for t, k in want.items())
    assert len(flat) == total
    starts = np.concatenate(([0], np.flatnonzero(flat == order.END)[:-1] + 1))
    got = Counter(tuple(flat[a:b].tolist()) for a, b in zip(starts, [*starts[1:], len(flat)]))
    plain = {t: k for t, k in want.items() if order.END not in t[:-1]}
    assert all(got[t] >= k for t, k in plain.items())
    assert order.materialise(odd.limit(0)).count() == 0


# -- language model -----------------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    w = {n: x.astype(np.float64) for n, x in lm_score.start_weights(rng).items()}
    x, y = rng.integers(0, 40, (2, lm_score.WINDOW)), rng.integers(0, lm_score.CLASSES, (2, lm_score.WINDOW))
    _, g, ids = lm_score.gradients(w, x, y)
    for n in w:
        at = tuple(rng.integers(0, s) for s in w[n].shape) if n != "e" else (int(x[0, 3]), 5)
        step = 1e-5
        old = w[n][at]
        w[n][at] = old + step
        up, *_ = lm_score.gradients(w, x, y)
        w[n][at] = old - step
        down, *_ = lm_score.gradients(w, x, y)
        w[n][at] = old
        got = g[n][int(np.searchsorted(ids, at[0])), at[1]] if n == "e" else g[n][at]
        assert got == pytest.approx((up - down) / (2 * step), rel=2e-3, abs=1e-7), n


def test_scorer_scores_each_token_once():
    rng = np.random.default_rng(1)
    w = lm_score.start_weights(rng)
    w["d"] = rng.standard_normal(lm_score.WINDOW).astype(np.float32)
    of = rng.integers(0, lm_score.CLASSES, lm_score.IDS).astype(np.int32)
    inside = -rng.random(lm_score.IDS)
    texts = [rng.integers(0, lm_score.IDS, n).astype(np.int32) for n in (1, 5, 31, 32, 33, 64, 65, 200)]

    def slow(ids):
        x = np.concatenate(([lm_score.END], ids[:-1]))
        total = 0.0
        for t in range(len(ids)):
            first = max(0, t // lm_score.STRIDE * lm_score.STRIDE + lm_score.STRIDE - lm_score.WINDOW)
            e = w["e"][x[first : t + 1]].astype(float)
            s = (e @ w["k"]) @ (e[-1] @ w["q"]) / math.sqrt(lm_score.WIDTH) + w["d"][np.arange(t - first, -1, -1)]
            a = np.exp(s - s.max())
            h = np.tanh((a / a.sum()) @ (e @ w["v"]) + e[-1] @ w["r"])
            z = h @ w["o"] + w["b"]
            p = np.exp(z - z.max())
            total += math.log10(p[of[ids[t]]] / p.sum()) + inside[ids[t]]
        return total

    assert [x.sum() for x in np.split(lm_score.Scorer(w, of, inside).token_logs(texts, block=3), np.cumsum([len(t) for t in texts])[:-1])] == pytest.approx([slow(t) for t in texts], rel=1e-4)


def test_words_are_encoded_by_themselves():
    encode = lm_score._ranks_encoder()
    for text in ["a bc the thing", "x\xa0y z", "\xa0 a", "a\u3000 \u2003 b", "it's 12,5 \x1c q", "", "\x85"]:
        words = lm_score.words_of(text)
        ids, at = lm_score.ids_of(words)
        want = [encode(" " + w.decode()).tolist() for w in words]
        assert [x.tolist() for x in np.split(ids, at[1:])][: len(words)] == want if words else len(ids) == 0


def test_score_does_not_depend_on_the_broadcast_words(odd):
    """Each word's share of the corpus counts, whether it is broadcast or joined."""
    few, all_ = ({(r["doc_id"], r["n_tokens"]): r["score"] for r in rows(lm_score.score(odd.filter("doc_id < 60 or doc_id > 9000"), top_words=k, steps=3))} for k in (5, 1 << 17))
    assert few.keys() == all_.keys() and all(few[d] == pytest.approx(all_[d], rel=1e-9) for d in few)


def test_lm_scores(odd):
    source = odd.select("doc_id", "text").collect()
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None]
    fold = lambda d: zlib.crc32(str(d).encode()) % 10
    count = Counter(w for r in source if fold(r.doc_id) != 0 for w in tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = {}
    for r in source:
        t = tokens(r.text)
        want[r.doc_id] = (fold(r.doc_id) == 0, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    out = rows(lm_score.score(odd, top_words=50, steps=5))
    assert len(out) == len(source)
    for r in out:
        held, size, known, total, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, size, known, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9) and r["score"] < 0
    assert lm_score.score(odd.limit(0), steps=1).count() == 0


def test_lm_beats_word_counts_on_held_out_texts(spark, small):
    documents = spark.read.parquet(f"{small.removesuffix('sf0.001')}sf0.01/documents.parquet")  # 200 texts are too few to learn from
    out = [r for r in rows(lm_score.score(documents, steps=800)) if r["held_out"]]
    assert len(out) > 10 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


# -- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline(spark, small, odd, labels, documents):
    import corpus_pipeline

    wanted = [n for n, _ in corpus_pipeline.STAGES]
    assert wanted == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = odd
    kept = stage["toxicity"](spark, docs, small)
    assert kept.columns == docs.columns
    bad = {r["doc_id"] for r in rows(toxicity.toxicity(docs, labels)) if r["predicted"]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in bad)

    single = stage["exact_dedup"](spark, docs, small)
    best = {}
    for r in docs.collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(best.values())

    near = stage["simhash_near_dedup"](spark, single, small)
    sets = [(r.doc_id, similar.shingles(r.text or "")) for r in single.select("doc_id", "text").collect()]
    up = {d: d for d, _ in sets}
    by_shingle = {}
    for d, x in sets:
        for y in x:
            by_shingle.setdefault(y, []).append(d)
    own = dict(sets)
    pairs = {(min(a, b), max(a, b)) for ds in by_shingle.values() for a in ds for b in ds if a != b}
    for a, b in sorted(pairs):
        if len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.8 and up[a] != up[b]:
            low, high = sorted((up[a], up[b]))
            up = {k: low if v == high else v for k, v in up.items()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(up.values())) and len(set(up.values())) < len(up)
    masked = stage["secret_scan"](spark, near, small)
    assert masked.columns == docs.columns and masked.count() == near.count()
    assert all(not secrets.find(r.text or "") for r in masked.collect())
    assert stage["packing"](spark, masked, small).count() > 0
    empty = docs.limit(0)
    assert all(f(spark, empty, small).count() == 0 for _, f in corpus_pipeline.STAGES)
    assert corpus_pipeline.run(spark, small).count() > 0


def test_near_dedup_keeps_rows_with_null_or_repeated_ids(spark, small):
    from tsmeter.llm import stages

    text = lambda seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, 300))
    made = [(None, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (2, text(6)), (7, text(6).upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.text for r in stages.drop_near_copies(spark, docs, small).collect())
    assert got == sorted(t for _, t in made[:-1])


def test_near_dedup_in_a_crowd(spark):
    """Texts that share a passage and are not alike; among them pairs that are."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    passage = word(440)
    made = [passage + word(60) for _ in range(400)]
    for _ in range(15):
        own = word(62)
        made += [passage + own, passage + own[:14] + word(48)]
    for _ in range(3):  # groups of copies with the passage
        own = word(60)
        made += [passage + own + word(k % 7) for k in range(60)]
    order = rng.permutation(len(made)).tolist()
    rows_ = [(i, " ".join(made[k])) for i, k in enumerate(order)]
    sets = [similar.hashes(t) for _, t in rows_]
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if up[i] != up[j] and similar.alike(sets[i], sets[j]):
                low, high = sorted((up[i], up[j]))
                up = [low if c == high else c for c in up]
    assert sum(c != i for i, c in enumerate(up)) == 15 + 3 * 59
    got = {r["node"]: r["component"] for r in similar.components(spark.createDataFrame(rows_, "row long, text string"), 5).collect()}
    assert [got.get(i, i) for i in range(len(sets))] == up


@pytest.mark.parametrize("cells", [1 << 20, 64])
def test_candidates_miss_no_pair(spark, monkeypatch, cells):
    """Whatever order the counters give."""
    monkeypatch.setattr(similar, "CELLS", cells)
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, rng.integers(1, 60))
        for _ in range(4):
            change = rng.random(len(base)) < rng.choice([0.0, 0.05, 0.12, 0.3])
            sets.append(np.unique(np.concatenate((np.where(change, rng.integers(0, 1 << 62, len(base)), base), rng.integers(0, 1 << 62, rng.integers(0, 4))))))
    df = spark.createDataFrame([(i, i if i % 9 else 0, x.tolist()) for i, x in enumerate(sets)], "row long, component long, shingles array<long>")
    got = {(r["a"], r["b"]) for r in similar.candidates(df).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if (i % 9 or j % 9) and similar.alike(sets[i], sets[j])}
    assert want <= got and len(want) >= 30 and len(got) < 6 * len(want)


def test_near_dedup_finds_what_brute_force_finds(spark, small):
    from tsmeter.llm import stages

    rng = np.random.default_rng(3)
    made = []
    for _ in range(12):  # chains of copies near 0.8, and one large group
        words = [f"w{x}" for x in rng.integers(0, 3000, 200)]
        for _ in range(25 if not made else 5):
            made.append(" ".join(words))
            for at in rng.integers(0, 200, rng.integers(3, 6)):
                words[at] = f"w{rng.integers(0, 3000)}"
    sets = [similar.shingles(t) for t in made]
    component = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and component[i] != component[j]:
                low, high = sorted((component[i], component[j]))
                component = [low if c == high else c for c in component]
    want = sorted(made[c] for c in set(component))
    assert 12 < len(want) < len(made)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in stages.drop_near_copies(spark, docs, small).collect()) == want


def test_near_dedup_links_by_simhash_first(spark, small, monkeypatch):
    """The trie self-join gives the fingerprints' links; those of texts that are not alike do not hold."""
    from tsmeter.llm import simhash, stages

    rng = np.random.default_rng(6)
    made = []
    for _ in range(20):
        words = [f"w{x}" for x in rng.integers(0, 9000, 1500)]
        made.append(" ".join(words))
        for at in rng.integers(0, 1500, 3):
            words[at] = "other"
            made.append(" ".join(words))
    made += [made[0].upper(), "", " ", *("ab" * k for k in range(1, 200))]
    fps = [simhash.fingerprint(t, 5) for t in made]
    want = {(i, j) for j in range(len(made)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= similar.BUDGET}
    marked = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in enumerate(fps)], "row long, fp long")
    got = {(r["a"], r["b"]) for r in similar.fingerprint_links(marked).collect()}
    up = lambda pairs: {r["node"]: r["component"] for r in similar.connected_components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert got <= want and up(got) == up(want) and sum(b < 80 for _, b in got) >= 30

    budgets, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda c, budget, leaf_size=None: (budgets.append(budget), links(c, budget, leaf_size))[1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in stages.drop_near_copies(spark, docs, small).collect())
    assert budgets == [similar.BUDGET] and kept == [*range(0, 80, 4), 81, *range(83, len(made))]


def test_language_model_does_not_depend_on_partitions(spark, documents, monkeypatch):
    """Rows dealt otherwise, in another order, give the same scores."""
    monkeypatch.setattr(lm_score, "SHARD", 8)
    docs = documents.filter("doc_id < 120")
    scores = [{r["doc_id"]: (r["score"], r["base_score"]) for r in lm_score.score(d, steps=60).collect()} for d in (docs.coalesce(1).orderBy("doc_id"), docs.repartition(7))]
    assert scores[0].keys() == scores[1].keys()
    for k, (a, base) in scores[0].items():
        assert a == pytest.approx(scores[1][k][0], rel=1e-9) and base == pytest.approx(scores[1][k][1], rel=1e-12)


def test_language_model_learns_from_every_training_token(spark, odd):
    """Each id of each training text, and its end, is a next id in some window of some round."""
    windows = lm_score.windows_of(odd)
    held = Counter()
    for number in range(lm_score.ROUNDS):
        for r in lm_score.of_round(windows, number).collect():
            ids = np.frombuffer(r["window"], "<u2").tolist()
            assert len(ids) == lm_score.WINDOW + 1
            held.update(zip(ids, ids[1:]))
    want, end = Counter(), lm_score.END
    for r in odd.select("doc_id", "text").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            ids = [end, *lm_score.ids_of(lm_score.words_of(r.text or ""))[0].tolist(), end]
            want.update(zip(ids, ids[1:]))
    assert sum(want.values()) > 100_000 and all(held[x] >= n for x, n in want.items())


def test_copies_of_a_window_are_reckoned_once_and_count_each():
    """Counts of windows give the gradients of repeated windows, and a shard forms each different window once a batch."""
    rng = np.random.default_rng(4)
    w = {n: x.astype(np.float64) for n, x in lm_score.start_weights(rng).items()}
    x, y = rng.integers(0, 40, (3, lm_score.WINDOW)), rng.integers(0, lm_score.CLASSES, (3, lm_score.WINDOW))
    times = np.array([1, 5, 2])
    loss, g, ids = lm_score.gradients(w, x, y, times)
    want, each, same = lm_score.gradients(w, x.repeat(times, axis=0), y.repeat(times, axis=0))
    assert loss == pytest.approx(want) and ids.tolist() == same.tolist() and all(np.allclose(g[n], each[n], rtol=1e-5, atol=1e-9) for n in w)
    rows_ = rng.integers(0, 40, (4, lm_score.WINDOW + 1))
    windows = np.repeat(rows_, [100, 1, 1, 60], axis=0)
    got = list(lm_score.batches_of(windows))
    assert [int(t.sum()) for _, t in got] == [lm_score.BATCH] * 3 + [162 - 3 * lm_score.BATCH]
    assert [len(b) for b, _ in got] == [1, 1, 4, 1]
    assert np.array_equal(np.concatenate([b.repeat(t, axis=0) for b, t in got]), windows)


def test_lexicon_has_the_terms_of_a_small_language(spark):
    made = [f"you are a gravelhead number {i}" for i in range(400)] + [f"eres un piedrolo numero {i}" for i in range(8)] + [f"a calm day at place {i}" for i in range(800)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 408)) for i in range(len(made))], "doc_id long, toxic int")
    lexicon, _ = toxicity.train(docs, marks)
    assert {"gravelhead", "piedrolo"} <= set(lexicon)
    out = {r["doc_id"]: r["predicted"] for r in rows(toxicity.toxicity(docs, marks))}
    assert all(out[i] == 1 for i in range(400, 408)) and not any(out[i] for i in range(408, len(made)))


def test_classes_are_reckoned_in_blocks_without_overflow(monkeypatch):
    """Neither the gradients nor the scores depend on the block's size, also where a logit is far too large for exp; the classes of all rows are never held at once."""
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 40, (3, lm_score.WINDOW)), rng.integers(0, lm_score.CLASSES, (3, lm_score.WINDOW))
    of, inside = rng.integers(0, lm_score.CLASSES, lm_score.IDS).astype(np.int32), -rng.random(lm_score.IDS)
    texts = [rng.integers(0, 40, n).astype(np.int32) for n in (1, 16, 17, 90)]
    for times in (1, 40):  # the latter: exp of a logit and of an attention would overflow
        w = {n: z * np.float32(times if n in "oqk" else 1) for n, z in lm_score.start_weights(rng).items()}
        w["b"] += rng.standard_normal(lm_score.CLASSES).astype(np.float32) * times
        w["d"] += rng.standard_normal(lm_score.WINDOW).astype(np.float32) * times
        got = []
        for rows_ in (7, 384):
            monkeypatch.setattr(lm_score, "ROWS", rows_)
            got.append((*lm_score.gradients(w, x, y)[:2], lm_score.Scorer(w, of, inside).token_logs(texts, block=5 if rows_ == 7 else 64)))
        (loss, g, logs), (loss_, g_, logs_) = got
        assert np.isfinite(loss) and loss == pytest.approx(loss_, rel=1e-5) and np.isfinite(logs).all() and logs == pytest.approx(logs_, rel=1e-4, abs=1e-4)
        assert all(np.isfinite(g[n]).all() and np.allclose(g[n], g_[n], rtol=1e-3, atol=1e-5 * np.abs(g[n]).max()) for n in g)
    import tracemalloc

    x, y = rng.integers(0, 40, (480, lm_score.WINDOW)), rng.integers(0, lm_score.CLASSES, (480, lm_score.WINDOW))
    w = lm_score.start_weights(rng)
    tracemalloc.start()
    lm_score.gradients(w, x, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 36e6  # 15,360 rows of classes alone are 15.7e6 (41.8e6 in all before, 30.3e6 now)
