"""Each operator against a brute-force version on a small, awkward corpus."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wedgeworks.llm import compression, decontamination, fitting, lines, mixing, ngram_join, repetition, sharding, substrings, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_repetition(docs, rows):
    got = by_id(repetition.repetition(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        t = t or ""
        ws = WORD.findall(t)
        grams = defaultdict(list)
        for i in range(len(ws) - 7):
            grams[tuple(ws[i : i + 8])].append(i)
        covered = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(8)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(covered), failed)
        assert got[d][:6] == want and not (failed and got[d][6])


def test_byte_shards(docs, rows):
    got = sharding.byte_shards(docs).orderBy("shard", "slot").collect()
    sizes = {d: len((t or "").encode()) + 1 for d, t, *_ in rows}
    assert {r["doc_id"]: r["size"] for r in got} == sizes and [r["doc_id"] for r in got] == sorted(sizes)
    assert {r["doc_id"]: r["text_crc32"] for r in got} == {d: zlib.crc32((t or "").encode()) for d, t, *_ in rows}
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r)
    for shard in per.values():
        assert [r["slot"] for r in shard] == list(range(len(shard)))
    starts = [sum(r["size"] for r in got if r["shard"] < s) for s in range(17)]
    total, largest = sum(sizes.values()), max(sizes.values())
    assert all(abs(starts[s] - total * s / 16) <= largest for s in range(17))


def test_mix(docs, rows):
    result = mixing.mix(docs)
    got = result.documents.collect()
    size = {d: len(WORD.findall(t or "")) for d, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    totals = Counter()
    for d in size:
        totals[source[d]] += size[d]
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(totals.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * totals[s]}
        for s in over or free:
            target[s] = 3.0 * totals[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], totals[s]) and math.isclose(r["target"], target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in names)
    assert sorted(map(tuple, mixing.mix(docs.repartition(2)).documents.collect()), key=str) == sorted(map(tuple, got), key=str)
    copies = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert max(copies.values()) <= 3 and all(copies[d] == 1 for d in size if not size[d])


def test_mix_tiny_sources(spark, docs):
    """Sources from 1 word to 80 000, at blocks of 401 words: each comes near its own target."""
    texts = [("huge", 200)] * 400 + [("large", 150)] * 150 + [("tiny", 7), ("tiny", 3), ("one", 1), (None, 40), ("small", 90), ("small", 0)]
    every = spark.createDataFrame([(i, " ".join(["w"] * n), "en", s, 0, 1, "x") for i, (s, n) in enumerate(texts)], docs.schema)
    result = mixing.mix(every, seats=256)
    got = result.documents.collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and len(got) == len(texts)
    target, taken, seated = {r["source"]: r["target"] for r in got}, Counter(), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    for r in result.schedule.collect():
        seated[r["source"]] += r["words"]
    assert taken == seated and len(target) == 6
    assert all(abs(taken[s] - t) <= (0.5 if s not in ("huge", "large") else 0.04 * t) for s, t in target.items())
    copies = Counter(r["source"] for r in mixing.mixed(every, seats=256).collect())
    assert copies["tiny"] == 6 and copies["one"] == 3 and copies["small"] == 4 and copies[None] == 3


def test_suffix_dedup(docs, rows):
    got = by_id(substrings.removed_strings(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    seen = set()
    for d, t, *_ in sorted(rows):
        raw = (t or "").encode()
        keep = [True] * len(raw)
        windows = [raw[i : i + 50] for i in range(len(raw) - 49)]
        for i, w in enumerate(windows):
            if w in seen:
                keep[i : i + 50] = [False] * 50
        seen.update(windows)
        spans = sum(not k and (i == 0 or keep[i - 1]) for i, k in enumerate(keep))
        kept = bytes(b for b, k in zip(raw, keep, strict=True) if k)
        assert got[d] == (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()), d


def test_line_dedup(docs, rows):
    got = by_id(lines.deduplicated(docs), "n_lines", "n_dropped", "kept_sha256")
    key = lambda x: x.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(d)
    for d, t, *_ in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and d != max(holders[key(x)]))]
        assert got[d] == (len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_token_files(spark, docs, rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = public.path("byte_bpe_50k.json")
    path = token_files.new_path(spark, "tokens")
    token_files.write(docs, model, path)
    got = by_id(token_files.checksums(token_files.read(spark, path)), "start", "n_tokens", "ids_crc32")
    tokenizer, start = Tokenizer.from_file(model), 0
    for d, t, *_ in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[d] == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)


def test_token_files_added_tokens(spark, docs):
    """The literal of an added token has that token's id, as in the library's plain call."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(model)
    name = next(iter(tokenizer.get_added_tokens_decoder().values())).content
    texts = [f"a {name} b", name, f"x{name}{name}\ny", f"{name[:-1]} a", f" {name}  ", "plain text", f"{name.upper()} b"]
    every = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x") for i, t in enumerate(texts)], docs.schema)
    path = token_files.new_path(spark, "tokens")
    token_files.write(every, model, path)
    got = by_id(token_files.read(spark, path), "start", "ids")
    start = 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == (start, b"".join(x.to_bytes(4, "little") for x in ids)), t
        start += len(ids)


def brute_groups(rows, n=3, percent=90):
    sets = {d: ngram_join.shingles((t or "").translate(LOWER).encode(), n) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_ngram_join(docs, rows):
    want = brute_groups(rows)
    assert by_id(ngram_join.jaccard_components(docs), "n_shingles", "component_id") == want
    assert by_id(ngram_join.jaccard_components(docs, rare=2), "n_shingles", "component_id") == want
    kept = {r["doc_id"] for r in ngram_join.without_copies(docs).collect()}
    assert kept == {d for d, (_, c) in want.items() if c == d}


def test_near_duplicates_stage(spark, docs, rows):
    import corpus_pipeline as P

    edited, next_id = [], 1000
    for i in (11, 15, 19):  # 100 words of prose; two words changed leave 0.87 of the 5-word and 0.88 of the 3-word shingles
        words = rows[i][1].split()[:100]
        for at in ((), (30, 70), (25, 60, 61)):
            edited.append((next_id, " ".join(f"new{j}" if j in at else w for j, w in enumerate(words)), *rows[i][2:]))
            next_id += 1
    every = [*rows, *edited]
    want, narrow = brute_groups(every, 5, 80), brute_groups(every)
    kept = {r["doc_id"] for r in P.near_duplicates(spark, spark.createDataFrame(every, docs.schema), "").collect()}
    assert kept == {d for d, (_, c) in want.items() if c == d} < {d for d, (_, c) in narrow.items() if c == d}


def test_decontamination(spark, docs, rows):
    texts = {d: t or "" for d, t, *_ in rows}
    passage = " ".join(texts[11].split()[20:80])
    items = [("a", passage), ("b", "unseen " * 2 + " ".join(f"q{i}" for i in range(30))), ("c", None), ("d", ""), ("a", passage)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    holders = {d for d, t in texts.items() if passage.lower() in t.lower()}
    found = decontamination.contaminated(docs, bench).collect()
    assert holders and {r["doc_id"] for r in found} == holders and {r["item_id"] for r in found} == {"a"}
    assert all(r["similarity"] >= 0.8 for r in found)
    kept = decontamination.without_items(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(texts) - holders
    assert decontamination.without_items(docs, bench.limit(0)).count() == len(rows)


def altered(rng, words, kind, new):
    """``words`` with about a fifth of the shingles gone."""
    most = (len(words) - 4) // 5
    cut = rng.randint(0, most)
    if kind != "edited":
        head = {"head": most, "tail": 0, "both": cut}[kind]
        return words[head : len(words) - (0 if kind == "head" else most - head)]
    for at in sorted(rng.sample(range(len(words)), max(1, most // 5)), reverse=True):
        words = [*words[:at], *rng.choice(([], [new()], [new(), words[at]])), *words[at + 1 :]]
    return words


@pytest.mark.parametrize("kind,least", [("head", 1), ("tail", 1), ("both", 1), ("edited", 0.95)])
def test_decontamination_recall(kind, least):
    """Passages down to the threshold, at any place of a text; those that no span holds to 0.8 don't count."""
    rng = random.Random(7)
    new = lambda: f"w{rng.randrange(3000)}"
    items = [[new() for _ in range(m)] for m in [*range(6, 60), *range(150, 280, 4)]]
    items += [[*items[40][:12], *(new() for _ in range(m))] for m in (9, 20, 30)]  # a common beginning weighs less
    index = decontamination.Index([(i, " ".join(x).encode()) for i, x in enumerate(items)])
    table, texts, due = decontamination.Signs(index.weights), [], []
    for i, item in enumerate(items):
        for _ in range(4):
            ahead = rng.randint(0, 30)
            words = [x.encode() for x in [*(new() for _ in range(ahead)), *altered(rng, item, kind, new), *(new() for _ in range(rng.randint(0, 30)))]]
            texts.append(b" ".join(words))
            due.append(i if max(index.similarity(i, words, at) for at in range(-len(item), len(words))) >= 0.8 else None)
    found = list(decontamination._matched(index, table, texts))
    hits = [i in f for i, f in zip(due, found, strict=True) if i is not None]
    assert len(hits) > len(texts) / 2 and sum(hits) >= least * len(hits), (sum(hits), len(hits))
    assert all(s >= 0.8 for f in found for s, _, _ in f.values())


SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("module,label,threshold,least", [(toxicity, "toxic", 0.5, 0.9), (compression, "quality", 0.3, 0.75)])
def test_held_out_accuracy(spark, module, label, threshold, least):
    pytest.importorskip("os").path.isdir(SF) or pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    score = toxicity.score_texts if module is toxicity else compression.classify
    got = score(docs, module.fit(docs, labels)).join(labels.where(F.col(label).isNotNull()), "doc_id").where("held_out").select("score", "predicted", label).collect()
    assert all(0 <= r[0] <= 1 and r[1] == (r[0] >= threshold) for r in got)
    positive, negative = ([r[0] for r in got if r[2] == c] for c in (1, 0))
    auc = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative) / (len(positive) * len(negative))
    assert auc >= least, auc


def _operators(spark, docs):
    labels = spark.createDataFrame([(d, d % 2, d % 2) for d in range(60)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("i", "some item text with eleven words in it to be looked for")], "item_id string, text string")
    public = pytest.importorskip("public_tokenizers")

    def tokens(d):
        path = token_files.new_path(spark, "tokens")
        token_files.write(d, public.path("byte_bpe_50k.json"), path)
        return token_files.checksums(token_files.read(spark, path))

    model, other = toxicity.fit(docs, labels), compression.fit(docs, labels)
    return {
        "repetition": repetition.repetition,
        "compression": lambda d: compression.classify(d, other),
        "sharding": sharding.byte_shards,
        "mixing": lambda d: mixing.mix(d).documents,
        "toxicity": lambda d: toxicity.score_texts(d, model),
        "substrings": substrings.removed_strings,
        "lines": lines.deduplicated,
        "tokens": tokens,
        "ngram": ngram_join.jaccard_components,
        "without_toxic": lambda d: toxicity.without_toxic(d, model, threshold=1.1),
        "mixed_kept": lambda d: mixing.mixed(d.where("text is null")),
    }


def test_odd_and_empty_tables(spark, docs, odd, none):
    for name, run in _operators(spark, docs).items():
        assert run(none).count() == 0, name
        assert run(odd).count() == (1 if name == "mixed_kept" else odd.count()), name
        fitted_on_nothing = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_texts(odd, fitted_on_nothing).count() == odd.count()
    bench = spark.createDataFrame([], "item_id string, text string")
    assert decontamination.contaminated(odd, bench).count() == 0
    assert decontamination.contaminated(none, spark.createDataFrame([("a", "b c d")], bench.schema)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in P.STAGES:
        out = stage(spark, before, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "sharding":
            assert out.count() == before.count()
            continue
        assert out.columns == docs.columns and out.count() > 0
        if name != "mixing":
            assert out.exceptAll(before).count() == 0
        before = out
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, out.collect()))


def test_mixed_clashing_columns(spark, docs, rows):
    """Columns named like the operator's own come back untouched."""
    names = ["_size", "_copy", "_k", "_s", "_n", "_taken", "_row", "_key", "_from", "size", "col"]
    extra = docs.select("doc_id", "text", "source", *(F.lit(f"mine {n}").alias(n) for n in names))
    got = mixing.mixed(extra)
    assert got.columns == extra.columns
    found = got.collect()
    assert all(r[n] == f"mine {n}" for r in found for n in names)
    want = sorted(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert sorted(r["doc_id"] for r in found) == want


def test_line_dedup_large_ids_and_long_runs(spark, docs):
    """Ids above 2^53 beside a null one; hashes of more rows than a task holds."""
    line, big = "a line that many documents have in common", 1 << 60
    texts = [(big, line), (big + 1, f"x\n{line}"), (big + 2, line.upper()), (None, line), (5, "short"), (big + 2, f"{line}\n{line}")]
    every = spark.createDataFrame([(d, t, "en", "s", 0, 1, "x") for d, t in texts], docs.schema)
    for options in ({}, {"batch": 2}, {"batch": 0}, {"batch": 1, "partitions": 1}):
        got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"]) for r in lines.deduplicated(every, **options).collect())
        assert got == [(0, 1, 1), (5, 1, 0), (big, 1, 1), (big + 1, 2, 1), (big + 2, 1, 0), (big + 2, 2, 0)], options


def test_decontamination_item_types(spark, docs, rows):
    """Item ids of any type come back as they are."""
    passage = " ".join(rows[11][1].split()[20:80])
    for kind, value in (("int", 7), ("long", 1 << 60), ("string", "x")):
        bench = spark.createDataFrame([(value, passage)], f"item_id {kind}, text string")
        found = decontamination.contaminated(docs, bench)
        assert found.schema["item_id"].dataType == bench.schema["item_id"].dataType and {r["item_id"] for r in found.collect()} == {value}


def test_size_differences():
    good, bad = (b"\n".join(f"{w} {i} {w}s were {w} {i * i}".encode() for i in range(300)) for w in ("river", "market"))
    model = compression.Model(compression.build([good[i : i + 90] for i in range(0, 9000, 90)], 4096), compression.build([bad[i : i + 90] for i in range(0, 9000, 90)], 4096), [0.0] * (compression.TERMS + 1))
    rows, p = model.scorer()([good[:3000], bad[:3000], b"", b"x", good + bad])
    assert rows.shape == (5, compression.FEATURES) and np.isfinite(rows).all() and (p == 0.5).all()
    assert (rows[0, 1::6] > 0).all() and (rows[1, 1::6] < 0).all()  # mean differences of blocks
    assert (rows[:, 2::6] <= rows[:, 1::6]).all() and (rows[:, 1::6] <= rows[:, 3::6]).all()
    assert compression.build([]) == b"" and compression.build([b"ab"]) == b"ab"


def test_logistic_steps_lower_the_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * [1, 30, 100]
    y = (x[:, 0] + x[:, 1] / 30 > 0).astype(int)  # separable, of unlike scales
    w = fitting.logistic(x, y)
    assert np.isfinite(w).all() and (((x @ w[:-1] + w[-1]) > 0) == y).mean() > 0.98
