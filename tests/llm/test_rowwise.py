"""Operators that read one text at a time, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tsmeter.llm import exact_dedup, langid, packing, quality, secrets, simhash, tokens, toxicity


def rows(df):
    return [r.asDict() for r in df.collect()]


# -- secrets ---------------------------------------------------------------------------------


def base_spans(text):
    out = []
    word = "".join
    keys = [word(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")] + ["[aA][pP][iI]_?[kK][eE][yY]"]
    for m in re.finditer(rf"({'|'.join(keys)})[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_secret_base_spans(odd):
    texts = {}
    for r in odd.select("doc_id", "text").collect():
        texts[r.doc_id] = r.text or ""
    found = rows(secrets.scan(odd))
    assert len(found) == odd.count()
    for r in found:
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("literal")] == want


@pytest.mark.parametrize(
    "text, secret",
    [
        ('pwd = "Tr0ub4dor&3x"', "Tr0ub4dor&3x"),
        ('a = "Xy12zz98Qq"\nclient_credentials = a', "Xy12zz98Qq"),
        ("db_passphrase: s3cr3t!Value9", "s3cr3t!Value9"),
        ("\"private_key\" => 'MIIEvQIBADANBg'", "MIIEvQIBADANBg"),
        ('half = "Ab3dEf"\nauth_key = half + "9hIjKl"', "9hIjKl"),
    ],
)
def test_literals_reach_sensitive_names(text, secret):
    at = text.index(secret)
    assert (at, at + len(secret), "literal") in [x[:3] for x in secrets.find(text)]


@pytest.mark.parametrize(
    "text, secret",
    [
        ('password: str = "Zx9!kk2Lq0"', "Zx9!kk2Lq0"),
        ('var passphrase string = "Zx9!kk2Lq0"', "Zx9!kk2Lq0"),
        ('const pwd: string | null = "Zx9!kk2Lq0"', "Zx9!kk2Lq0"),
        ('pwd = prefix + "AbC1!23xyz"', "AbC1!23xyz"),
        ('pwd = os.getenv("DATABASE_PASSWORD", "Lq0!zz81Ax")', "Lq0!zz81Ax"),
        ('pwd = """Lq0!zz81Ax"""', "Lq0!zz81Ax"),
        ('passphrase = "correct horse battery staple 9"', "correct horse battery staple 9"),
        ("my_secret_" + "n" * 500 + ' = "Qw3rTy9!zz#k"', "Qw3rTy9!zz#k"),
        ('pwd = "Samples8!todos"', "Samples8!todos"),
    ],
)
def test_forms_of_assignment(text, secret):
    at = text.index(secret)
    assert (at, at + len(secret), "literal") in [x[:3] for x in secrets.find(text)]


def test_rest_of_a_literal_is_reported():
    text = 'password = "Abcdefgh1!xyzSECRET99"'
    assert [x[2:] for x in secrets.find(text)] == [("assign", 12, 21), ("literal", 21, 33)]
    assert secrets.redact(text) == 'password = "[SECRET]"'


@pytest.mark.parametrize(
    "text",
    [
        'a = "Xy9"\n' + "a = a + a\n" * 10_000 + "pwd = a",
        "a=" * 300_000,
        "x=f(" * 100_000,
        'pwd = "' + "aB3!" * 250_000 + '"',
        "token_" + "n" * 1_000_000 + " = 5",
        'a = "Xy9!"\nb = ' + " + ".join(["a"] * 100_000) + "\npwd = b",
        "a: b " * 200_000,
        '= "' * 200_000,
        "-" * 500_000 + "=" + ":" * 100_000,
    ],
)
def test_work_is_linear(text):
    import time

    start = time.monotonic()
    secrets.find(text)
    assert time.monotonic() - start < 10


def test_constants_against_an_interpreter():
    """Random programs: what reaches a sensitive name, by running them on whole strings."""
    rng = np.random.default_rng(4)
    names = ["pwd", "auth_key", "title", "a", "b", "signingKey"]
    for _ in range(300):
        text, held, want = "", {}, set()
        for _ in range(int(rng.integers(1, 9))):
            name = names[rng.integers(len(names))]
            text += f"{name} {rng.choice(['=', ':=', '=>'])} "
            value, spans = "", []
            for i in range(int(rng.integers(1, 4))):
                text += " + " if i else ""
                if held and rng.random() < 0.5:
                    other = list(held)[rng.integers(len(held))]
                    text += other
                    value, spans = value + held[other][0], spans + held[other][1]
                else:
                    word = "".join(rng.choice(list("aB3!xZ9#kQ"), int(rng.integers(1, 9))))
                    spans = [*spans, (len(text) + 1, len(text) + 1 + len(word))]
                    text += f'"{word}"'
                    value += word
            text += "\n"
            held[name] = (value, spans)
            if secrets.name_score(name) * secrets.literal_score(secrets.literal(value, (0, 0))) >= secrets.REPORT:
                want.update(spans)
        assert {x[:2] for x in secrets.find(text) if x[2] == "literal"} == want, text


@pytest.mark.parametrize("text", ['pwd = "changeme"', 'title = "Tr0ub4dor&3x"', "secret_santa: the list of names", 'pwd = "<your password>"', "see http://token/abcdefghijk", "a = b\nb = a"])
def test_innocent_assignments(text):
    assert [x for x in secrets.find(text) if x[2] == "literal"] == []


def test_redaction_leaves_nothing_and_keeps_the_rest(odd):
    for r in secrets.redacted(odd).select("doc_id", "text", "n_chars").collect():
        assert r.text is None or (secrets.find(r.text) == [] and r.n_chars == len(r.text))
    assert secrets.redact('a password = "abcdefgh1" b') == 'a password = "[SECRET]" b'


# -- quality ---------------------------------------------------------------------------------


def test_quality_measures(odd):
    texts = {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").collect()}
    for r in rows(quality.measures(odd)):
        text = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen, again = set(), 0
        for x in lines:
            again += x in seen
            seen.add(x)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        twice = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(twice)]
        assert r["base_failed"] == (len(w) < 50 or 100 * len(twice) > 50 * len(w))


def test_binomial_tail(spark):
    from math import comb, exp

    from pyspark.sql import functions as F

    data = [(k, n) for n in (1, 5, 40, 300) for k in (0, 1, 2, 3, 7) if k < n * 0.05] + [(2, 3000), (100, 3000), (149, 3000)]
    for r in spark.createDataFrame(data, "k long, n long").select("k", "n", quality.log_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect():
        exact = sum(comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1))
        assert exp(r.p) == pytest.approx(exact, rel=1e-9)


def test_verdict_by_brute_force(spark):
    """Order, exact tails, fixed sequence and verdicts on a small table, in plain Python."""
    from math import comb

    rng = np.random.default_rng(8)
    made, marks = [], []
    for i in range(1500):
        bad = i % 5 == 0
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(50, 500)))]
        if bad and i % 2 or rng.random() < 0.01:
            words = [w + "###" * int(rng.integers(0, 2)) for w in words]
        text = " ".join(words) + ("\n" + "same line again" ) * (int(rng.integers(0, 9)) if bad else int(rng.random() < 0.05))
        made.append((i, text, ["en", "de"][i % 3 == 0]))
        if i % 3 != 2:
            marks.append((i, int(not bad), 0))
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality long, toxic long")
    measured = {r["doc_id"]: r for r in rows(quality.measures(docs))}
    value = {"symbols": lambda r: r["n_symbols"] / max(r["word_chars"], 1), "repeats": lambda r: r["n_repeat_words"] / max(r["n_words"], 1), "dup_lines": lambda r: r["n_dup_lines"] / max(r["n_lines"], 1), "long_words": lambda r: r["word_chars"] / max(r["n_words"], 1), "short": lambda r: -r["n_words"]}
    label = {d: q for d, q, _ in marks}
    used = {}
    for lang in ("en", "de"):
        own = [r for r in measured.values() if r["stratum"] == lang and not r["base_failed"]]
        good, bad, plain = ([r for r in own if label.get(r["doc_id"]) == x] for x in (1, 0, None))
        tests = []
        for i, (rule, cut, loose) in enumerate(quality.TESTS):
            hit = lambda r: value[rule](r) > cut  # noqa: B023, E731
            if n := sum(map(hit, bad)):
                tests.append((-n / (sum(map(hit, plain)) + 1) if plain else 0.0, loose, -n, i))
        used[lang] = []
        for *_, i in sorted(tests):
            now = [*used[lang], i]
            k = sum(any(value[quality.TESTS[j][0]](r) > quality.TESTS[j][1] for j in now) for r in good)
            n = len(good)
            if sum(comb(n, x) * 0.05**x * 0.95 ** (n - x) for x in range(k + 1)) > 0.05 / 2:
                break
            used[lang] = now
    assert all(used.values())
    out = rows(quality.quality(docs, labels))
    for r in out:
        m = measured[r["doc_id"]]
        want = not m["base_failed"] and not any(value[quality.TESTS[j][0]](m) > quality.TESTS[j][1] for j in used[m["stratum"]])
        assert r["kept"] == want
    assert any(not r["kept"] and not r["base_failed"] for r in out)


def test_cutoffs_reject_bad_documents_of_the_tables(spark, small):
    folder = f"{small.removesuffix('sf0.001')}sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = quality.quality(spark.read.parquet(f"{folder}/documents.parquet"), labels).filter("not base_failed").join(labels, "doc_id")
    got = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert got.get((0, False), 0) > 10 and got.get((1, False), 0) <= 0.05 * got[(1, True)]


def test_many_strata_all_have_rules(spark):
    from pyspark.sql import functions as F

    docs = spark.range(70 * 300).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 70).alias("lang"), F.expr("array_join(transform(sequence(1, 120), i -> concat('a', i * (id + 3) % 9973, if(id % 10 = 1, '###', ''))), ' ')").alias("text"))
    marks = docs.select("doc_id", F.expr("cast(doc_id div 70 % 10 <> 1 as long)").alias("quality"))
    docs = docs.withColumn("text", F.expr("array_join(transform(sequence(1, 120), i -> concat('a', i * (doc_id + 3) % 9973, if(doc_id div 70 % 10 = 1, '###', ''))), ' ')"))
    assert quality.quality(docs, marks).filter("kept").select("doc_id").join(marks, "doc_id").filter("quality = 0").count() == 0


def test_quality_controls_false_rejection(spark, documents, labels):
    from pyspark.sql import functions as F

    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.expr("repeat(concat('w', id, '### x', id, '### '), 60)")).otherwise(F.expr("array_join(transform(sequence(1, 500), i -> concat('a', i * (id + 3) % 9973)), ' ')")).alias("text"), F.lit("en").alias("lang"))
    marks = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("long").alias("quality"), F.lit(0).alias("toxic"))
    out = quality.quality(docs, marks).join(marks, "doc_id")
    got = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) <= 0.05 * 3000 and got.get((0, True), 0) == 0
    assert quality.quality(documents, labels.limit(0)).filter("kept = base_failed").count() == 0


# -- languages and toxicity ----------------------------------------------------------------


def test_language(spark, odd):
    out = {}
    for r in rows(langid.identify(odd)):
        out.setdefault(r["doc_id"], r)
    source = odd.select("doc_id", "lang", "text").collect()
    right = [out[r.doc_id]["lang_pred"] == r.lang for r in source if r.doc_id < 9000 and out[r.doc_id]["held_out"]]
    assert len(right) > 20 and np.mean(right) > 0.9
    for r in source:
        got = out[r.doc_id]
        assert got["held_out"] == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= got["score"] <= 1
        assert (got["lang_pred"] == "und") == (not any(c.isalpha() for c in r.text or ""))


def test_language_by_brute_force(odd):
    """Exact trigram sets in place of the filters: the same languages, about the same scores."""
    source = [r for r in odd.select("doc_id", "lang", "text").collect()]
    fold = lambda d: zlib.crc32(str(d).encode()) % 4
    grams = lambda t: [g for c in langid.trigrams(t) for g in c.tolist()]
    counts = {}
    for r in source:
        if fold(r.doc_id) != 2 and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = Counter()
    for c in rates.values():
        for g, x in c.items():
            top[g] = max(top[g], x)
    owned = {lang: {g for g, x in rates[lang].items() if c[g] >= 2 and x >= 0.5 * top[g]} for lang, c in counts.items()}
    out = {}
    for r in rows(langid.identify(odd)):
        out.setdefault(r["doc_id"], r)
    same, total = 0, 0
    for r in source:
        g = grams(r.text or "")
        share = {lang: sum(x in o for x in g) / max(len(g), 1) for lang, o in owned.items()}
        if sum(share.values()) and any(c.isalpha() for c in r.text or ""):
            best = max(sorted(share), key=lambda x: share[x])
            total += 1
            same += out[r.doc_id]["lang_pred"] == best and abs(out[r.doc_id]["score"] - share[best] / sum(share.values())) < 0.05
    assert total > 150 and same >= 0.98 * total


def test_many_languages_need_more_than_one_plane():
    langs = [f"l{i:03}" for i in range(70)]
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" * 4 for i in range(70)]
    got = [np.concatenate(list(langid.trigrams(w))) for w in words]
    f = langid.Filters(langs, np.concatenate(got), np.repeat(np.arange(70), [len(g) for g in got]))
    assert [f.predict(w)[0] for w in words] == langs


def test_levenshtein_matches():
    terms = ["idiot", "disgusting", "scum", "sot"]
    lexicon = toxicity.Lexicon(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    words = {"idiot", "1diot", "idot", "idiiot", "idiots", "disgustng", "d1sgust1ng", "disguting", "skum", "scm", "cum", "sot", "sit", "widget", "", "i", "discussing"}
    rng = np.random.default_rng(1)
    words |= {"".join(rng.choice(list("idotscumgn"), rng.integers(2, 11))) for _ in range(3000)}
    found = lexicon.near(sorted(words))
    for w in words:
        near = sorted((distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits(t))
        got = found.get(w)
        assert (got and (got[1], got[0])) == (near[0] if near else None), w


def test_toxicity(spark, documents, labels, odd):
    base = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"{base} {'you utter grobnik' if i % 3 == 0 else 'a fine day'} {i}", "en", "s", 1) for i in range(600)] + [(9999, base + " you gr0bnik", "en", "s", 1)], documents.schema)
    marks = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 3 = 0 as int) as toxic").filter("doc_id < 600")
    out = rows(toxicity.toxicity(docs, marks))
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) == (r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    strange = rows(toxicity.toxicity(odd, labels))
    assert len(strange) == odd.count() and all(0 <= r["score"] <= 1 for r in strange)
    assert all(r["predicted"] == 0 for r in rows(toxicity.toxicity(odd, labels.limit(0))))


# -- empty tables ------------------------------------------------------------------------------


def test_empty_tables(spark, empty, labels):
    for f in (secrets.scan, secrets.redacted, langid.identify, exact_dedup.exact_dedup, simhash.near_duplicates, packing.pack, lambda d: quality.quality(d, labels), lambda d: toxicity.toxicity(d, labels)):
        assert f(empty).collect() == []


# -- tokens and packing ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer_file(odd, tokenizer):
    encode = tokens.byte_bpe()
    extra = ["a  b", "a \nb", "\n\n\nx", "x\t\ty", "it's  WE'LL", "日本語 テキスト", "🙂🙂 a", "\r\n\r\n", "a\x1cb \x1f", "٣٤ ½", "a  b", "  ", "　　x"]
    for text in [r.text or "" for r in odd.select("text").collect()] + extra:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


@pytest.mark.parametrize("options", [{}, {"length": 256, "segments": 4}, {"length": 100, "segments": 3, "loss": 40}])
def test_packing(odd, tokenizer, options):
    length, segments, loss = options.get("length", 2048), options.get("segments", 128), options.get("loss") or options.get("length", 2048)
    out = packing.pack(odd, **options).toPandas()
    texts = Counter((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect())
    want = Counter()
    for (doc_id, text), n in texts.items():
        want[(doc_id, np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes())] += n
    out = out.sort_values(["doc_id", "start"])
    got = Counter()
    for doc_id, g in out.groupby("doc_id"):
        copies = sum(n for (d, _), n in want.items() if d == doc_id)
        if copies == 1:
            assert (g["start"].to_numpy() == np.concatenate(([0], g["length"].cumsum()[:-1]))).all()
            got[(doc_id, b"".join(g["ids"]))] += 1
            assert (g["doc_tokens"] == g["length"].sum()).all()
    assert got == Counter({k: n for k, n in want.items() if n == 1})
    padded = 0
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        total = g["length"].sum()
        assert total <= length and len(g) <= segments and g["loss_tokens"].sum() <= loss
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1].tolist()]
        padded += 0 if total & (total - 1) == 0 else length - total
    assert padded <= 0.01 * out["length"].sum() or length == 100


def test_packing_of_instruction_data(spark, tokenizer):
    """Prompts bear no loss: all three limits bind, and repeated ids keep their rows apart."""
    rng = np.random.default_rng(6)
    made = []
    for i in range(400):
        words = [f"word{x}" for x in rng.integers(0, 999, int(rng.integers(1, 260)))]
        text = " ".join(words)
        made.append((i // 2, text, [None, 0, len(text) // 2, len(text)][i % 4]))
    docs = spark.createDataFrame(made, "doc_id long, text string, chars int")
    out = packing.pack(docs, length=512, segments=6, loss=200, prompt_chars="chars").toPandas()
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    want = Counter((d, tuple([*ids(t), 1]), len(ids(t[: c or 0]))) for d, t, c in made)
    reached = np.zeros(3, bool)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 512 and len(g) <= 6 and g["loss_tokens"].sum() <= 200
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1].tolist()]
        reached |= [g["length"].sum() == 512, len(g) == 6, g["loss_tokens"].sum() == 200]
    assert reached.all()
    tokens_placed = Counter()
    for r in out.itertuples():
        tokens_placed[r.doc_id] += r.length
        options = [(x, p) for (d, x, p) in want if d == r.doc_id and len(x) == r.doc_tokens and np.array(x[r.start : r.start + r.length], "<u4").tobytes() == r.ids]
        assert any(r.loss_tokens == r.length - max(1, min(r.length, p - r.start)) for _, p in options)
    assert tokens_placed == Counter({d: sum(len(x) * n for (e, x, _), n in want.items() if e == d) for d, _, _ in made})


# -- near and exact copies --------------------------------------------------------------------------


def test_exact_dedup(odd):
    by_text = {}
    source = odd.select("doc_id", "text").collect()
    for r in source:
        by_text.setdefault(r.text or "", []).append(r.doc_id)
    out = rows(exact_dedup.exact_dedup(odd, bucket_cells=8))
    texts = {r.doc_id: r.text or "" for r in source}
    assert sorted(r["doc_id"] for r in out) == sorted(r.doc_id for r in source)
    for r in out:
        group = by_text[texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(group), len(group), r["doc_id"] == max(group))
        assert r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_directory_splits_full_buckets(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    crowded = (np.int64(5) << np.int64(40)) + rng.permutation(1 << 12)[:300]  # one long common prefix
    hashes = np.unique(np.concatenate((rng.integers(-(2**63), 2**63, 500), crowded)))
    df = spark.createDataFrame([(int(h),) for h in hashes], "hash long")
    some = exact_dedup.build_directory(df.filter("hash not between 5497558138880 and 5497558142976"), 20)
    got = df.select("hash", some.bucket(F.col("hash")).alias("bucket")).toPandas()
    u, bucket = got["hash"].to_numpy().view(np.uint64), got["bucket"].to_numpy().view(np.uint64)
    for h, b in zip(u.tolist(), bucket.tolist()):
        depth = some.depths[h >> (64 - some.bits)]
        assert b == (h >> (64 - depth)) << (64 - depth) if depth else b == 0
    spread = got[~got["hash"].isin(crowded)].groupby("bucket").size()
    assert spread.max() <= 20 and len(spread) > 25 and len(set(some.depths)) > 1


def test_hash_collisions_form_chains(spark):
    """Texts under one hash are told by their bytes."""
    rows = spark.createDataFrame([(i, t, 7, 0) for i, t in enumerate(["a", "b", "a", "c", "b", "a"])], "doc_id long, text string, hash long, bucket long")
    got = {(r.text_sha256[:2], r.keep_id, r.group_size) for r in exact_dedup.build_index(rows, exact_dedup.Directory(0, b"\0")).collect()}
    assert got == {(hashlib.sha256(t.encode()).hexdigest()[:2], k, n) for t, k, n in (("a", 5, 3), ("b", 4, 2), ("c", 3, 1))}


def brute_fingerprint(text, k):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd):
    for r in odd.select("text").distinct().limit(60).collect():
        assert simhash.fingerprint(r.text or "") == brute_fingerprint(r.text or "", 3)


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("budget, leaf", [(0, None), (2, None), (2, 5), (3, 40), (6, 20)])
def test_trie_join(spark, budget, leaf):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 30, dtype=np.uint64)
    fps = {0, 2**64 - 1, 1, 2**63}
    for c in centres:  # a chain of near ones round each centre
        for _ in range(25):
            c = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                c ^= 1 << int(b)
            fps.add(c)
    hot = int(centres[0])
    fps |= {hot ^ int(x) for x in rng.integers(0, 2**20, 300)}  # many under one prefix
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, id long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(df, budget, leaf).collect()}
    a = np.array(fps, np.uint64)
    d = np.bitwise_count(a[:, None] ^ a[None, :])
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(d <= budget, 1)))}


def test_near_duplicates(odd):
    source = odd.select("doc_id", "text").distinct().collect()
    fp = {r.doc_id: brute_fingerprint(r.text or "", 3) for r in source}
    ids = sorted(fp)
    a = np.array([fp[i] for i in ids], np.uint64)
    d = np.bitwise_count(a[:, None] ^ a[None, :])
    want = brute_components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(d <= 2, 1)))])
    out = rows(simhash.near_duplicates(odd))
    assert len(out) == odd.count()
    for r in out:
        assert np.int64(r["fp"]).astype(np.uint64) == fp[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]


def test_near_duplicates_with_null_and_repeated_ids(spark, monkeypatch):
    """Fingerprints are the nodes: a null id links others, a repeated id does not."""
    a, b = 0x0123456789ABCDEF, 0x7EDCBA9876543210
    marks = [(3, a ^ 0b11), (None, a), (7, a ^ 0b1100), (4, b ^ 0b11), (5, b), (5, a ^ (0xFF << 32)), (9, a ^ (0xFF << 32) ^ 1), (None, 0xF0F0 << 40), (None, 0xF0F0 << 40)]
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in marks], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: df)
    got = sorted(((r["doc_id"], r["component_id"]) for r in rows(simhash.near_duplicates(None))), key=str)
    assert got == sorted([(3, 3), (None, 3), (7, 3), (4, 4), (5, 4), (5, 5), (9, 5), (None, None), (None, None)], key=str)


def test_long_chain_components(spark):
    from tsmeter.llm.common import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 90), (95, 100)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 95: 90, 100: 90}


def test_doubled_constants_stay_small():
    """Memory is linear in the text, with many letters and whatever is added."""
    import resource
    import string

    alphabet = string.ascii_letters + string.digits
    for line in ("a = a + a\n", "a = a + b\n", "b = a + 'Zq'\na = b + a\n"):
        text = f'a = "{alphabet}"\nb = "{alphabet[::-1]}xyz"\n' + line * 50_000 + "token = a\n"
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        pairs = secrets.lex(text)
        assert pairs[-1][0] == "token" and secrets.literal_score(pairs[-1][1]) > 0.9
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB
