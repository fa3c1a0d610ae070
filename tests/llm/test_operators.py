"""Every operator on small hostile tables against brute force: NULLs, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from proofline.llm import (byte_bpe, decontamination, language_model, personal_data, repeats, search, simhash, substring_dedup,
                           suffix_dedup, token_counts, toxicity)
from proofline.llm.common import mixed

SCHEMA = "doc_id long, text string, n_words long, anchor long, hit_words string, score double"


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def corpus() -> list[tuple]:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ab", "c", "dé", "E", "字", "x1"]) for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(70)]
    texts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(25)]
    texts += [" ".join([*(word() for _ in range(rng.randint(0, 20))), *passage, *(word() for _ in range(rng.randint(0, 20)))]) for _ in range(12)]
    texts += ["one  two\tthree " * 40, "lone", "", " \n\t ", "aa " * 300, " ".join(passage), " ".join(passage), " ".join(passage * 30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (None, " ".join(passage[3:60])), (None, None), (7, texts[7]), (7, texts[7]), (8, " ".join(passage[:50]))]
    return [(i, t, 5, 6, "clash", 0.5) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [(r[0], r[1] or "") for r in corpus()]


def test_word_repeats_equal_brute_force(docs, none):
    size = 20
    rows = sorted(set(pairs()) | {(i, "") for i, t in pairs() if not t}, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(r[1].encode(), 42) >> 63)))
    seen, expected = set(), {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = [False] * len(words)
        for s in range(len(words) - size + 1):
            window = tuple(words[s:s + size])
            if window in seen:
                gone[s:s + size] = [True] * size
            seen.add(window)
        expected[i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)] = 0
    got = substring_dedup.remove_repeats(docs, window=size)
    assert got.count() == len(corpus())
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()} == set(expected)
    assert substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("group", [300, 1])
def test_byte_repeats_equal_brute_force(docs, group):
    width, rows = 60, [t.encode() for _, t in pairs()]
    counts = Counter(b[i:i + width] for b in rows for i in range(len(b) - width + 1))
    expected = Counter()
    for (i, _), b in zip(pairs(), rows, strict=True):
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if counts[b[s:s + width]] > 1:
                gone[s:s + width] = [True] * width
        expected[i, len(b), sum(gone), sum(k for k, _ in itertools.groupby(gone)), bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    got = suffix_dedup.remove_repeats(docs, width=width, gram=8, group=group)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()) == expected


def test_byte_repeats_of_nothing(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_segments_cover_every_window_once():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 50):
        codes = mixed(rng.integers(0, letters, 700).astype(np.uint64))
        _, starts, counts, _ = repeats.segments(codes, 30, 5)
        assert starts[0] == 0 and (starts[1:] == (starts + counts)[:-1]).all() and starts[-1] + counts[-1] == 700 - 29


def test_fingerprints_and_components_equal_brute_force(docs, none):
    def fingerprint(text):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x20\x09-\x0D]+", words)
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    rows = [(i, fingerprint(t)) for i, t in pairs()]
    parent = {f: f for _, f in rows}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f
    for a, b in itertools.combinations(list(parent), 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, f in rows:
        if i is not None:
            least[root(f)].append(i)
    expected = Counter((i, f, min(least[root(f)], default=None)) for i, f in rows)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["print"] % (1 << 64), r["component_id"]) for r in got) == expected
    assert simhash.near_duplicates(none).count() == 0


def test_trees_lose_no_link():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30, 3)).astype(np.uint64)
    prints = np.unique(np.concatenate(((centres[:, None] ^ flips[..., 0] ^ flips[..., 1] * rng.integers(0, 2, (40, 30)).astype(np.uint64)).ravel(), rng.integers(0, 1 << 63, 2000).astype(np.uint64))))
    tree = simhash.build_tree(prints[::3], 40, 2)
    leaves = defaultdict(set)
    for leaf, own in simhash.leaves_of(prints, tree, 2):
        for p in own.tolist():
            leaves[p].add(leaf)
    for i, p in enumerate(prints):
        for q in prints[i + 1:][np.bitwise_count(prints[i + 1:] ^ p) <= 2].tolist():
            assert leaves[int(p)] & leaves[q]


def test_contamination_equals_brute_force(spark, docs, none):
    long = corpus()[30][1].split()
    items = [(1, " ".join(long[10:40])), (2, "lone"), (3, None), (4, "one TWO, three"), (4, "one TWO, three"), (None, "aa"), (5, "aa aa aa")]
    table = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(str(i), split(t)[s:s + 13]) for i, t in items if i is not None for s in range(max(1, len(split(t)) - 12)) if split(t)]
    expected = Counter()
    for i, t in pairs():
        words, hit, owners = split(t), set(), set()
        for item, w in windows:
            for s in range(len(words) - len(w) + 1):
                if words[s:s + len(w)] == w:
                    hit |= set(range(s, s + len(w)))
                    owners.add(item)
        expected[i, len(words), len(hit), len(owners), sha(",".join(sorted(owners))), bool(hit) and 20 * len(hit) >= len(words)] += 1
    for limit in (1 << 20, 40):          # at once, and in slices
        got = decontamination.contamination(docs, table, broadcast_bytes=limit)
        assert Counter(tuple(r) for r in got.collect()) == expected
    bad = sum(n for key, n in expected.items() if key[-1])
    assert decontamination.decontaminate(docs, table).count() == len(corpus()) - bad
    spans = decontamination.decontaminate(docs, table, mode="spans")
    assert spans.columns == docs.columns and decontamination.contamination(spans, table).where("n_words > 0").agg(F.max("n_words")).first()[0] > 0
    assert decontamination.contamination(none, table).count() == 0
    assert decontamination.contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.cut_words("A b, c! D e", [1], [3]) == "A ! D e"


def test_personal_data(spark, docs, none):
    cases = {
        "mail a.b+c@x-1.org, 1.2.3.4 and 300.1.1.1": ["email:5:18", "ip:20:27"],
        "call +1 (524) 555-2896 pay 4396177793418310": ["card:27:43", "phone:5:22"],
        "john (at) example (dot) com": ["email:0:27"],
        "bob at mail dot example dot org": ["email:0:31"],
        "jоe@exаmple.com": ["email:0:15"],
        "４３９６１７７７９３４１８３１０": ["card:0:16"],
        "four three nine six one seven seven seven nine three four one eight three one zero": ["card:0:82"],
        "plus four nine one five one two three four five six seven": ["phone:0:57"],
        "+4​9 151 2345 6789": ["phone:0:18"],
        "we met at the dot of noon, one two three": [],
        "a@b c@d.e": ["email:4:9"],
        "10.0.0 dot 1": ["ip:0:12"],
    }
    for text, spans in cases.items():
        base, added = personal_data.find_spans(text)
        assert personal_data._named(sorted(base + added)) == spans, text
    frame = spark.createDataFrame([(1, "x a@b.cd y", "s"), (2, None, "s"), (3, "", "s")], "doc_id long, text string, spans string")
    assert {tuple(r) for r in personal_data.redact(frame).collect()} == {(1, "x <EMAIL> y", "s"), (2, None, "s"), (3, "", "s")}
    assert personal_data.find_personal_data(docs).count() == len(corpus()) and personal_data.find_personal_data(none).count() == 0


def test_each_disguise_alone_is_found():
    for address in ("john @ example.com", "john @example.com", "john@ example.com", "john\t@\nexample.com", "john [at] example.com", "john {@} example.com", "john at example dot com", "john@example dot com"):
        for text in (address, f"mail {address} now", f"(mail) {address} now"):
            start = text.index(address)
            base, added = personal_data.find_spans(text)
            assert personal_data._named(base + added) == [f"email:{start}:{start + len(address)}"], text
            assert personal_data.redacted(text) == text.replace(address, "<EMAIL>")


def test_plain_spans_equal_patterns():
    rng = random.Random(2)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(8000):
        text = "".join(rng.choice("ab@.+1 29-()% _é0") for _ in range(60))
        found = [(0, *m.span()) for m in email.finditer(text)]
        found += [(1, *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in personal_data.CARD.finditer(text):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
                found.append((2, *m.span()))
        found += [(3, *m.span()) for m in personal_data.PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        assert personal_data.detect(text) == sorted(found)


@pytest.fixture(scope="module")
def odd_texts(spark):
    rng = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "'ll", "'", "1", "é", "字", "😀", "!", "<|endoftext|>", " ", "\x1c", "²", "word ", " the", "\t"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 50, 400, 900]))) for _ in range(60)]
    texts += ["a" * 5000, " " * 900, "x" * 700 + " y" * 500, "<|endoftext|>" * 100]
    rows = [*enumerate(texts), (None, "abc " * 200), (1, texts[1]), (400, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")), {i: t or "" for i, t in rows}


def test_encoding_equals_the_library_and_round_trips(odd_texts, none):
    import public_tokenizers
    import tiktoken

    frame, texts = odd_texts
    path = byte_bpe.vocabulary_path(byte_bpe.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for chunk, overlap in ((1 << 16, 512), (100, 40)):
        got = byte_bpe.encode(frame, path, chunk=chunk, overlap=overlap)
        rows = got.collect()
        assert len(rows) == frame.count() and all(list(r["ids"]) == own.encode_ordinary(texts[r["doc_id"]]) for r in rows)
        assert all(bytes(r["decoded"]) == texts[r["doc_id"]].encode() for r in byte_bpe.decode(got, path).collect())
    assert byte_bpe.encode(none, path).count() == 0


def test_token_counts_equal_the_library(odd_texts, none):
    from tokenizers import Tokenizer

    frame, texts = odd_texts
    path = byte_bpe.vocabulary_path(token_counts.VOCABULARY)
    own = Tokenizer.from_file(path)
    for chunk, overlap in ((1 << 16, 512), (100, 40)):
        rows = token_counts.count_tokens(frame, path, chunk=chunk, overlap=overlap, limit=50).collect()
        assert len(rows) == frame.count()
        for r in rows:
            n = len(own.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 50)
    assert token_counts.count_tokens(none, path).count() == 0


def test_search_equals_brute_force(docs, none):
    rows = sorted({(i, t) for i, t in pairs()}, key=repr)
    counts = [Counter(t.encode().lower().split()) for _, t in rows]
    df = Counter(w for c in counts for w in c)
    n, mean = len(rows), sum(sum(c.values()) for c in counts) / len(rows)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    got = defaultdict(list)
    for r in search.search(docs, F.col("doc_id") % 3 == 0, k=4, terms=None, min_df=1, shards=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], round(r["score"], 9)))
    expected = {}
    for (i, _), asked in zip(rows, counts, strict=True):
        if i is None or i % 3 or not asked:
            continue
        scores = [sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in asked if w in c) for c in counts]
        expected[i] = [(k + 1, round(s, 9)) for k, s in enumerate(sorted((s for s in scores if s > 0), reverse=True)[:4])]
    assert dict(got) == expected
    assert search.search(none, F.col("doc_id") % 20 == 0).count() == 0


def test_search_takes_every_word_by_default(spark):
    common = [f"w{i}" for i in range(60)]
    texts = [" ".join(common[i:] + [f"own{i}"]) for i in range(30)] + ["alone here", ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = [Counter(t.encode().split()) for t in texts]
    df = Counter(w for c in counts for w in c)
    n, mean = len(texts), sum(sum(c.values()) for c in counts) / len(texts)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    got = defaultdict(list)
    for r in search.search(frame, F.col("doc_id") % 5 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], round(r["score"], 9)))
    for q in (0, 5, 10, 15, 20, 25, 30):
        scores = [(-sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in counts[q] if w in c), d) for d, c in enumerate(counts)]
        expected = [(k + 1, d, round(-s, 9)) for k, (s, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:10])]
        assert got[q] == expected, q


def test_search_does_not_depend_on_shards_and_blocks(docs):
    ask = lambda **bounds: sorted((tuple(r) for r in search.search(docs, F.col("doc_id") % 3 == 0, **bounds).collect()), key=repr)
    assert ask() == ask(shard_rows=50, block_words=40)


def test_wand_is_exact():
    rng = np.random.default_rng(8)
    for _ in range(200):
        lists, scores = [], defaultdict(float)
        for _ in range(rng.integers(1, 6)):
            places = np.sort(rng.choice(600, rng.integers(1, 400), replace=False))
            values = rng.integers(1, 5, len(places)) / 4
            lists.append(search.PostingList(places, values))
            for d, v in zip(places.tolist(), values.tolist(), strict=True):
                scores[d] += v
        best = sorted(((s, d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:7]
        assert search.block_max_wand(lists, 7) == best


def test_language_scores(spark, docs, none):
    rows = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in language_model.language_scores(docs, heavy=20).collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [(i, [*t.encode().lower().split(), b""]) for i, t in pairs()]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, types = sum(counts.values()), len(counts)
    expected = [(i, held(i), len(ws), sum(w in counts for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in ws), 6)) for i, ws in tokens]
    assert Counter(rows) == Counter(expected)
    assert language_model.language_scores(none).count() == 0


def test_language_model_gradient_and_normalisation():
    rng = np.random.default_rng(2)
    classes = rng.integers(0, 3, 4000).astype(np.int16)
    rows = np.stack([np.concatenate(([0], classes[:-1]))] * language_model.FEATURES, axis=1).astype(np.int32)   # the class repeats what the feature says
    classes = rows[:, 0].astype(np.int16)
    weights = np.zeros((language_model.ROWS + 1, language_model.CLASSES), np.float32)
    for _ in range(3):
        language_model.gradient_steps(weights, np.zeros(language_model.ROWS + 1, np.int64), rows, classes, 0.35)
    logits = language_model.class_logits(weights, rows[:10])
    assert (logits.argmax(axis=1) == classes[:10]).all()


def test_toxicity_learns_and_never_sees_held_out_labels(spark, none):
    rng = random.Random(6)
    plain = lambda: " ".join(rng.choice(["sun", "tree", "walk", "river", "house"]) for _ in range(30))
    rows, labels = [], []
    for i in range(400):
        toxic = int(i % 5 == 0)
        rows.append((i, plain() + (" you vile fool " if toxic else " ") + plain(), "clash"))
        wrong = zlib.crc32(str(i).encode()) % 4 == 2       # held-out labels are turned round: a model that saw them would fail
        labels.append((i, 1 - toxic if wrong else toxic))
    rows += [(900, None, "x"), (901, "", "x"), (None, "vile fool", "x"), (5, rows[5][1], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame(labels + [(902, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame, table)
    got = {(r["document"]["doc_id"]): r["score"] for r in model.score(frame).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[900] < 0.3 and got[901] < 0.3
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in range(400))
    assert toxicity.fit(frame, table.limit(0)).score(frame).agg(F.max("score")).first()[0] == 0
    assert model.score(none.select("doc_id", "text")).count() == 0


def test_spaced_words_count_in_texts_of_any_length():
    scorer = toxicity.Scorer({"idiot": 5.0})
    at = [toxicity.FEATURES.index(name) for name in ("obfuscated", "hidden hits")]
    for filler in (10, 1_000_000):                          # the second text is over 1 MiB
        got = toxicity.features_of("i d i o t " + "it " * filler, scorer)
        assert [got[i] for i in at] == [100 / (filler + 5)] * 2
    plain = re.compile(r"(?<!\w)(?:\w[ .*-]){3,}\w(?!\w)")
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab_é .*-,") for _ in range(rng.randint(0, 60)))
        assert toxicity.SPACED.findall(text) == plain.findall(text)
