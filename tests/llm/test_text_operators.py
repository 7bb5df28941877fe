"""Operators on whole texts against brute force, with the edge rows that each must bear."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dyadlake.llm import fingerprints, jaccard_join, packing, quality_classifier, quality_rules, suffix_dedup, token_files
from dyadlake.operators.lineage import shared_dir
from dyadlake.llm.tokens import Encoder, vocabulary

COMMON = "this very same passage of more than one hundred bytes stands in many documents, again and again, as it is often copied. "
TEXTS = [
    None,
    "",
    "   \n ",
    "one",
    "two words",
    "Some plain words of a short text. It has two sentences.",
    COMMON + "And then its own ending follows here, with words of its own to tell.",
    "A start of its own. " + COMMON + COMMON,
    COMMON + "And then its own ending follows here, with words of its own to tell.",
    "word " * 60,
    "é" * 150 + " ü" + "é" * 150,
    "long " + " ".join(f"w{i % 977}x{i % 13}" for i in range(6000)),
    "it's  don't \t x\r\n'Re  y . ,a.b 3.5%%% <|endoftext|> z",
    "\n".join(["same line here"] * 4 + ["other line"]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(10 * i, t, "en", "s", 0, 1.5) for i, t in enumerate(TEXTS)]
    rows += [(60, TEXTS[6], "en", "s", 0, 2.5), (None, "no id, " + COMMON, "en", None, 0, 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part double").repartition(3)


def empty(docs):
    return docs.limit(0)


def rows_of(docs):
    """(doc_id, text) in the operators' order: null first, then doc_id, then text."""
    return sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_suffix_dedup(docs):
    seen, want = set(), []
    for i, text in rows_of(docs):
        b = text.encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p] += 1
                gone[p + 100] -= 1
            seen.add(b[p : p + 100])
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        want.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.deduplicate(docs).collect()]
    assert Counter(got) == Counter(want)
    assert suffix_dedup.deduplicate(empty(docs)).count() == 0


def test_jaccard_components(spark):
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in rng.integers(0, 5000, 220)]
    texts = [None, "", "a b", "A B", "a b c d e"]
    for _ in range(30):  # near copies about the threshold, in one long list
        w = list(base)
        for at in rng.integers(0, len(w), 4):
            w[at] = f"n{rng.integers(0, 9999)}"
        texts.append(" ".join(w))
    texts += [" ".join(base), " ".join(base).upper(), " ".join(f"z{i}" for i in rng.integers(0, 5000, 90))]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    label = list(range(len(texts)))
    for _ in label:
        for i in label:
            for j in range(len(texts)):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(d).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert 1 < len(set(label[5:37])) < 32 or len(set(label[5:37])) == 1
    assert jaccard_join.join(d.limit(0)).count() == 0


def test_jaccard_links_small_sets(spark):
    """Pairs of 1 to 20 shingles that no third set helps, with one word more, less or other."""
    texts = []
    for n in range(1, 21):
        for k in range(6):
            w = [f"p{n}k{k}w{i}" for i in range(n + 3)]
            texts += [w, [[*w, "x"], ["x", *w], [*w, "x", "y"], ["x", *w, "y"], [*w[:-1], "x"], w[2:]][k]]
    want = {}
    for a in range(0, len(texts), 2):
        s, t = ({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for w in texts[a : a + 2])
        linked = 100 * len(s & t) >= 85 * len(s | t)
        want |= {a: (len(s), a), a + 1: (len(t), a if linked else a + 1)}
    assert want[6 * 12 - 12] == (6, 60) and want[61] == (7, 60)
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(d).collect()} == want


def test_jaccard_live_entries_of_linked_sets_suffice(spark):
    """Of two linked sets' common shingles, the k-th stands before place k + what one side lacks."""
    n = np.arange(1, 1001)
    own = np.minimum(n, jaccard_join.DEPTH * jaccard_join.prefix_lengths(n))
    need = np.array([r["x"] for r in spark.range(1, 1001).withColumnRenamed("id", "n").orderBy("n").select(F.expr(jaccard_join.LEAST_LIVE).alias("x")).collect()])
    for a in n.tolist():
        b = n[(n <= a) & (100 * n >= 85 * a)]
        common = jaccard_join.needed(a, b)  # at more common shingles both counts grow
        sure = np.minimum(np.minimum(own[a - 1] - (a - common), own[b - 1] - (b - common)), common)[common <= b]
        assert (sure >= need[a - 1]).all() and (sure >= need[b - 1][common <= b]).all()


def brute_components(texts):
    """Component (least index) of each text by comparing all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    label = list(range(len(texts)))
    of = lambda i: i if label[i] == i else of(label[i])
    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= 85 * len(s | sets[j]):
                a, b = of(i), of(j)
                label[max(a, b)] = min(a, b)
    return [(len(s), of(i)) for i, s in enumerate(sets)]


def test_jaccard_families_across_cells(spark, monkeypatch):
    """Loose families of several generations, far more than a cell holds, meet across cells."""
    monkeypatch.setattr(jaccard_join, "CELL", 8)
    rng = np.random.default_rng(11)
    texts = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(60)]
        for k in range(40):
            w = list(base)
            for at in rng.choice(60, rng.integers(0, 5), replace=False):
                w[at] = f"x{rng.integers(0, 40)}"
            texts.append(" ".join(w))
            if k % 10 == 9:
                base = w
    want = brute_components(texts)
    assert 3 < len({c for _, c in want}) < 100
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(d).collect()}
    assert got == dict(enumerate(want))


def test_jaccard_short_texts_of_one_family(spark, monkeypatch):
    """Many 17-word texts that differ in the last word: each links with every other or with none."""
    monkeypatch.setattr(jaccard_join, "CELL", 64)
    texts = [" ".join([f"s{i}" for i in range(16)] + [f"end{k}"]) for k in range(600)]
    texts += [" ".join([f"long{i}" for i in range(40)] + [f"end{k}"]) for k in range(600)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(d).collect()}
    assert got == {i: (0 if i < 600 else 600) for i in range(1200)}  # 13 of 15 and 37 of 39


def test_jaccard_rows_without_or_with_equal_ids(spark):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(5, near, "en", "s", 1), (5, near, "en", "s", 1), (5, near + " more", "en", "s", 1), (None, near, "en", "s", 1), (7, "", "en", "s", 1), (7, None, "en", "s", 1), (None, "alone here with some words", None, None, None), (8, "w " * 70_000 + "end", "en", "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(d).collect())
    assert got == Counter({(5, 11, 5): 2, (5, 12, 5): 1, (None, 11, 5): 1, (7, 0, 7): 2, (None, 2, None): 1, (8, 2, 8): 1})
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(d.withColumn("root", F.lit("clash"))).collect())
    one = next(t for i, t in kept if i == 5)
    assert one in (near, near + " more") and kept == Counter([(5, one), (7, ""), (7, None), (None, "alone here with some words"), (8, rows[7][1])])


def thue_morse(k: int) -> str:
    s = "a"
    for _ in range(k):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_regular_texts_keep_apart(spark):
    """Thue-Morse words and their complements collide under any polynomial hash modulo 2**64."""
    x = thue_morse(11)
    y = x.translate(str.maketrans("ab", "ba"))
    d = spark.createDataFrame([(0, x), (1, y)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(d).collect()} == {0: 0, 1: 1}
    first, second = fingerprints.compare_with_next(d).orderBy("doc_id").collect()
    assert first["fingerprint"] != second["fingerprint"] and first["near_next"] < 1
    pad = lambda s: "".join(c + f"{i % 23:02d}" for i, c in enumerate(s))
    words = pad(x) * 8
    other = pad(y) * 8
    kept = suffix_dedup.deduplicate(spark.createDataFrame([(0, words[:49_152]), (1, other[:49_152])], "doc_id long, text string")).orderBy("doc_id").collect()
    seen, gone = set(), [0, 0]
    for k, t in enumerate((words[:49_152].encode(), other[:49_152].encode())):
        hit = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                hit[p : p + 100] = True
            seen.add(t[p : p + 100])
        gone[k] = int(hit.sum())
    assert [r["n_removed"] for r in kept] == gone


def test_packing(docs):
    tokenizer = Encoder("word_bpe_49k.json").tokenizer
    got = packing.pack(docs, window=512).collect()
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for i, text in rows_of(docs):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(by[i, len(ids)], key=lambda r: r["start"])
        for r in mine:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in mine) % len(ids) == 0
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    assert packing.pack(empty(docs)).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 101, 400))[::-1]
    number, offset = packing.best_fit_decreasing(sizes, 100)
    left: list[int] = []
    for s, n, o in zip(sizes.tolist(), number.tolist(), offset.tolist()):
        fits = [x for x in left if x >= s]
        if fits:
            assert left[n] == min(fits) and o == 100 - left[n]
        else:
            assert n == len(left) and o == 0
            left.append(100)
        left[n] -= s


def test_token_files_round_trip(spark, docs):
    tokenizer = Encoder("byte_bpe_50k.json").tokenizer
    folder = f"{shared_dir(spark)}/round-trip"
    manifest = token_files.write(docs, folder, length=64)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(manifest).collect())
    want, at = [], 0
    for i, text in rows_of(docs):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    import pyarrow as pa

    path = manifest.first()["path"].removeprefix("file://") + ".ids.arrow"
    with pa.memory_map(path) as source:
        file = pa.ipc.open_file(source)
        assert file.schema.field("input_ids").type == pa.list_(pa.uint16(), 64) and len(file.get_batch(0).column(0)[0]) == 64
    assert token_files.read(token_files.write(empty(docs), folder)).count() == 0


def test_names_are_told_apart_by_sorting():
    from time import process_time

    names = np.random.default_rng(5).integers(0, 1 << 62, 400_000).astype(np.uint64)
    names[::3] = names[0]
    for some in (names, names[:1], names[:0]):
        assert np.array_equal(suffix_dedup.distinct(some), np.sort(np.unique(some)))

    def least(run):
        took = []
        for _ in range(3):
            at = process_time()
            run()
            took.append(process_time() - at)
        return min(took)

    assert least(lambda: suffix_dedup._dealt_names(names, 0, 1)) < 1.2 * least(lambda: np.unique(names, return_index=True)[0])


def test_encoder_equals_the_library():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = Encoder(name)
        texts = [t or "" for t in TEXTS] + ["x " * i + " y" for i in range(3)]
        want = [[*x.ids, 2] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        got = [ids[a:b].tolist() for _, ids, at in e.encode(texts, run_bytes=50) for a, b in zip(at[:-1], at[1:])]
        assert got == want


def test_encoder_equals_a_fresh_tokenizer_on_special_tokens():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> z", "a<|endoftext|>b  <|startoftext|>\n c", "<|endoftext|><|endoftext|>", " \n<|endoftext|>  \n z"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        fresh = Tokenizer.from_file(vocabulary(name))
        want = [[*x.ids, 2] for x in fresh.encode_batch(texts, add_special_tokens=False)]
        got = [ids[a:b].tolist() for _, ids, at in Encoder(name).encode(texts) for a, b in zip(at[:-1], at[1:])]
        assert got == want


def test_encoder_starts_anew_beyond_its_bound(monkeypatch):
    from dyadlake.llm import tokens

    monkeypatch.setattr(tokens, "KNOWN_BYTES", 2_000)
    e = Encoder("byte_bpe_50k.json")
    texts = [f"new{i} words{i * 7} again " * 3 + "q" * (300 if i % 9 == 0 else 1) for i in range(60)]
    want = [[*x.ids, 2] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [ids[a:b].tolist() for _, ids, at in e.encode(texts, run_bytes=100) for a, b in zip(at[:-1], at[1:])]
    assert got == want and len(e.known) < 20


def test_encoder_keeps_frequent_pieces_beyond_its_bound(monkeypatch):
    from dyadlake.llm import tokens

    monkeypatch.setattr(tokens, "KNOWN_BYTES", 4_000)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e, learnt = Encoder(name), []
        monkeypatch.setattr(e, "_learn", lambda pieces, learn=e._learn, learnt=learnt: (learnt.extend(pieces), learn(pieces)))
        texts = ["frequent again" + "".join(f" {chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for k in range(8)) for i in range(60)]
        want = [[*x.ids, 2] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        got = [ids[a:b].tolist() for _, ids, at in e.encode(texts, run_bytes=1) for a, b in zip(at[:-1], at[1:])]
        assert got == want and learnt.count(" again") == learnt.count("frequent") == 1
        assert sum(4 * len(p) + 160 for p in e.known) == e.cost <= 4_000


def test_encoder_on_random_texts():
    import random

    rng = random.Random(4)
    some = [*"aB zé×÷Àÿ.,!'$<|\n\t\r 1\x1c\xa0\u2003x日\u0301", "<|endoftext|>", " the", " don't", "\nThe", "$$$", " \n", "\n\n"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 30))) for _ in range(3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = Encoder(name)
        want = [[*x.ids, 2] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        got = [ids[a:b].tolist() for _, ids, at in e.encode(texts, run_bytes=5000) for a, b in zip(at[:-1], at[1:])]
        assert e.direct and got == want


def test_fingerprints(docs):
    rows = rows_of(docs)
    got = fingerprints.compare_with_next(docs).collect()
    want = Counter()
    for k, (i, x) in enumerate(rows):
        half = len(x) // 2
        want[i, len(x), hashlib.sha256((x[: len(x) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {}
    for i, x in rows:
        for r in got:
            if r["doc_id"] == i and r["n_chars"] == len(x):
                assert by.setdefault(x, r["fingerprint"]) == r["fingerprint"]
    assert len(set(by.values())) == len(by)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    long = next(r for r in got if r["doc_id"] == 110)
    assert 0.4 < long["near_edited"] < 0.7 and long["near_next"] < 0.1
    assert fingerprints.compare_with_next(empty(docs)).count() == 0
    assert fingerprints.compare_with_next(docs.filter("doc_id = 110")).first()["near_next"] == 1.0


def test_fingerprint_strings_give_likeness_and_edits(docs):
    """near_* and the edits recomputed from the strings by plain multisets of leaves."""
    leaves = lambda f: Counter(re.findall(r":([0-9a-f]{8}\.[0-9]+)", f))
    weigh = lambda c: sum(int(x.split(".")[1]) * n for x, n in c.items())

    def near(a, b):
        x, y = leaves(a), leaves(b)
        return 2 * weigh(x & y) / (weigh(x) + weigh(y)) if x or y else 1.0

    rows = sorted(fingerprints.compare_with_next(docs.filter("doc_id <> 60")).collect(), key=lambda r: r["doc_id"])
    texts = {r["doc_id"]: r["text"] or "" for r in docs.filter("doc_id <> 60").collect()}
    for r, nxt in zip(rows, [*rows[1:], rows[0]]):
        assert r["near_edited"] == pytest.approx(near(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(near(r["fingerprint"], nxt["fingerprint"]))
        assert weigh(leaves(r["fingerprint"])) == len(texts[r["doc_id"]].encode())
        spans = fingerprints.edits(r["fingerprint"], r["edited_fingerprint"])
        assert r["edit_start"] == (spans[0][0] if spans else None)
    a = "one two three four.\n" * 3 + "\n" + " ".join(f"w{i}" for i in range(400)) + "\nlast line"
    b = a.replace("w200 ", "changed ")
    x, y = fingerprints.fingerprints([a, b])
    (start, end), = fingerprints.edits(x, y)
    assert start <= b.index("changed") < end < start + 400 and fingerprints.edits(x, x) == []
    assert x[:32] != y[:32] and fingerprints.likeness(x, y) > 0.8


def test_quality_rules(docs):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(docs).collect()}
    for i, x in rows_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [line for line in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        r = got[i, len(w)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(inside))
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules.judge(empty(docs)).count() == 0


def test_rules_em_equals_a_plain_one_and_finds_the_truth(spark):
    """Votes drawn from known accuracies: the DataFrame EM against numpy's, and both near the truth."""
    rng = np.random.default_rng(4)
    truth = np.array([(0.95, 0.6), (0.9, 0.7), (0.97, 0.5), (0.85, 0.8)])
    good = rng.random(6000) < 0.7
    right = rng.random((6000, 4)) < np.where(good[:, None], truth[:, 0], truth[:, 1])
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((6000, 4)) < 0.9)
    pattern, n = np.unique(votes, axis=0, return_counts=True)
    names = ["a", "b", "c", "d"]
    d = spark.createDataFrame([(*map(int, p), int(k)) for p, k in zip(pattern, n)], "a int, b int, c int, d int, n long")
    state = quality_rules.estimate(d, names, rounds=60)
    acc, prior = np.tile([0.9, 0.5], (4, 1)), 0.8
    for _ in range(60):
        up, down = (np.where(pattern == v, np.log(x), 0) for v, x in ((1, acc[:, 0]), (-1, 1 - acc[:, 0])))
        up2, down2 = (np.where(pattern == v, np.log(x), 0) for v, x in ((-1, acc[:, 1]), (1, 1 - acc[:, 1])))
        q = 1 / (1 + np.exp(np.log(1 - prior) + (up2 + down2).sum(1) - np.log(prior) - (up + down).sum(1)))
        new = [[((w[:, None] * (pattern == v)).sum(0) + 1) / ((w[:, None] * (pattern != 0)).sum(0) + 2) for w, v in ((n * q, 1), (n * (1 - q), -1))]][0]
        moved = max(abs(np.stack(new, 1) - acc).max(), abs(((n * q).sum() + 1) / (n.sum() + 2) - prior))
        acc, prior = np.stack(new, 1), ((n * q).sum() + 1) / (n.sum() + 2)
        if moved < 1e-5:
            break
    assert state["prior"] == pytest.approx(prior, abs=1e-6) and abs(prior - 0.7) < 0.06
    assert np.array([state["acc"][r] for r in names]) == pytest.approx(acc, abs=1e-6) and abs(acc - truth).max() < 0.1
    swapped = quality_rules.named({"prior": 0.3, "acc": {r: (1 - b, 1 - a) for r, (a, b) in state["acc"].items()}})
    assert swapped["prior"] == 0.7 and swapped["acc"]["a"] == pytest.approx(state["acc"]["a"])


def test_rules_bear_clashing_columns(docs):
    names = ["quality", "kept", "symbols", "n_words", "_t", "base_failed"]
    clash = docs.select("doc_id", "text", *[F.lit("x").alias(c) for c in names])
    assert quality_rules.judge(clash).count() == docs.count()


def test_classifier_bears_repeated_rows_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "good words here", 1), (1, "good words here", 1), (2, "### $$$", 2), (3, "w " * 60_000, 3)], "doc_id long, text string, p_good int")
    l = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.score(d, quality_classifier.train(d, l)).count() == 4
    nothing = d.limit(0)
    assert quality_classifier.score(nothing, quality_classifier.train(nothing, l)).count() == 0


def test_classifier_gradient_equals_a_plain_fit():
    """With full weights (no scaling), the fit reaches what plain numerical descent reaches."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"k{k}" for k in rng.integers(0, 12, 8)) for _ in range(120)]
    grades = np.array([min(2, t.count("k1 ") + t.count("k2")) for t in texts])
    buckets, at, dense = quality_classifier.features(pa.array(texts))
    model = quality_classifier.fit(buckets, at, dense, grades, rounds=3000, rate=0.02)

    def loss(m):
        p = np.concatenate([np.ones((120, 1)), m.tails(m.scores(buckets, at, dense)), np.zeros((120, 1))], 1)
        return -np.log(np.maximum(p[np.arange(120), grades] - p[np.arange(120), grades + 1], 1e-12)).mean()

    best = loss(model)
    for i in range(quality_classifier.SHAPE):  # no step along a dense weight or a threshold helps
        for step in (-0.02, 0.02):
            d = model.dense.copy()
            d[i] += step
            assert loss(quality_classifier.Model(model.weights, d, model.cuts)) > best - 2e-3
    for step in (-0.05, 0.05):
        assert loss(quality_classifier.Model(model.weights, model.dense, model.cuts + step)) > best - 1e-3
    assert best < 0.7 * -sum(np.mean(grades == g) * np.log(np.mean(grades == g)) for g in set(grades.tolist()))


def test_quality_classifier_learns_grades(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        words = [f"k{k}" for k in rng.integers(0, 400, 40)]
        grade = i % 3
        words = ["###$$$"] * 40 if grade == 0 else [*words, "nasty", "nasty,"] if grade == 1 else words
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, int(grade > 0), int(grade == 1)))
    d = spark.createDataFrame([*rows, (1000, None, "x"), (1001, "", "x")], "doc_id long, text string, kept string")
    l = spark.createDataFrame([*labels, (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    held_out = l.filter("doc_id % 5 <> 0 or doc_id is null")
    got = {r["doc_id"]: r for r in quality_classifier.score(d, quality_classifier.train(d, held_out)).collect()}
    test = [i for i in range(600) if i % 5 == 0]
    assert np.mean([got[i]["kept"] == (i % 3 == 2) for i in test]) > 0.95
    mean = [np.mean([got[i]["expected_grade"] for i in test if i % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2] and len(got) == 602
    free = quality_classifier.score(d, quality_classifier.train(d, l.limit(0)))
    assert free.filter("not kept").count() == 0


@pytest.mark.parametrize("n", [200, 3000])
def test_quality_classifier_learns_rare_words(n):
    """Words that only few rated documents hold, all of them toxic, tell held-out ones."""
    rng = np.random.default_rng(n)
    draw = lambda k: [f"k{k}" for k in rng.integers(0, 400, k)]
    rare = [f"n{j}" for j in range(n // 32)]
    texts = [" ".join(draw(40) if i % 4 else [*draw(39), rare[i // 4 % len(rare)]]) for i in range(n)]
    grades = np.array([2 if i % 4 else 1 for i in range(n)])
    model = quality_classifier.fit(*quality_classifier.features(pa.array(texts)), grades)
    new = pa.array([" ".join([*draw(39), w]) for w in rare * 5] + [" ".join(draw(40)) for _ in rare * 5])
    good = model.tails(model.scores(*quality_classifier.features(new)))[:, 1] >= 0.5
    assert good[: len(new) // 2].mean() < 0.2 and good[len(new) // 2 :].mean() > 0.9
