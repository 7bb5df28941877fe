"""The pipeline's stages on a small fixture."""

import random
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from dyadlake.llm import packing
from dyadlake.llm.common import DOC_COLUMNS
from dyadlake.llm.tokens import vocabulary


def test_stages(spark, tmp_path):
    words = lambda i, n: " ".join(f"w{(i * 31 + k * 7) % 211}s{k % 17}" for k in range(n))
    shared = words(999, 70)
    rows = [(i, words(i, 80) + ". " + (shared if i % 4 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s0", 0) for i in range(5)] + [(200, None, "en", None, 0), (201, "", None, "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = str(tmp_path)
    d, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, at)
        kept[name] = d.collect()
        if name != "packing":
            assert set(d.columns) == set(DOC_COLUMNS)
            d = spark.createDataFrame(kept[name], d.schema)
    ids = lambda name: {r["doc_id"] for r in kept[name]}
    assert set(range(40)) <= ids("quality_classifier")
    assert ids("ngram_jaccard_join") & set(range(100, 105)) == set() and set(range(40)) <= ids("ngram_jaccard_join")
    with_shared = [r for r in kept["suffix_array_dedup"] if shared in (r["text"] or "")]
    assert [r["doc_id"] for r in with_shared] == [0]
    assert all(r["n_chars"] == len(r["text"]) for r in kept["suffix_array_dedup"])
    assert ids("source_mixing") <= ids("suffix_array_dedup") and ids("packing") == ids("source_mixing")
    assert corpus_pipeline.queries()["pipeline"](spark, at).count() == len(kept["packing"])


def planted():
    """(doc_id, text) and (doc_id, quality, toxic): sound, toxic and poor documents, near copies, exact copies,
    shared passages, a repeated row, null and empty texts."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 4)))
    passage = " ".join(word() for _ in range(60))
    rows, rated = [], []
    for i in range(60):
        w = [word() for _ in range(140)]
        if i % 3 == 1:
            for at in r.sample(range(140), 30):
                w[at] = r.choice(["vilescum", "hatebile", "cursefilth"])
        elif i % 3 == 2:
            w = [r.choice(["###", "$$$", "%%", "click", "||"]) for _ in range(60)]
            w = w + [word() for _ in range(3)]
        rows.append((i, " ".join(w)))
        rated.append((i, int(i % 3 != 2), int(i % 3 == 1)))
    for i in (0, 3, 6):  # near copies: two words of some 140
        w = rows[i][1].split(" ")
        w[20], w[90] = "anotherword", "yetanother"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, rows[9][1]), (301, rows[9][1]), (12, rows[12][1])]
    rows += [(400 + i, " ".join(word() for _ in range(70)) + " " + passage + " " + " ".join(word() for _ in range(70))) for i in range(5)]
    return rows + [(500, None), (501, "")], rated


def brute_kept(rows):
    """One row of each group of linked texts, by all pairs."""
    from .test_text_operators import brute_components

    rows = sorted(set(rows), key=lambda x: x[0])
    roots = brute_components([t for _, t in rows])
    return [x for i, (x, (n, root)) in enumerate(zip(rows, roots, strict=True)) if not n or root == i]


def brute_cut(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda x: x[0]):
        b, gone = (text or "").encode(), set()
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(b[p : p + 100])
        out[i] = bytes(c for p, c in enumerate(b) if p not in gone).decode()
    return out


def test_each_stage_equals_a_plain_version_of_it(spark, tmp_path):
    """Rows of the stages, chained, against brute force on what the stage before gave."""
    rows, rated = planted()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in rows], schema)
    spark.createDataFrame(rated, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, got, d = dict(corpus_pipeline.STAGES), {}, docs
    for name in stages:
        got[name] = stages[name](spark, d, str(tmp_path)).collect()
        if name != "packing":
            d = spark.createDataFrame(got[name], schema)
    have = lambda name: [(r["doc_id"], r["text"]) for r in got[name]]
    first = have("quality_classifier")
    ids = {i for i, _ in first}
    assert sorted(first, key=str) == sorted([x for x in rows if x[0] in ids], key=str)  # a document goes or stays whole
    assert ids >= {i for i, q, t in rated if q and not t} | {200, 203, 206, 300, 301, 400, 401, 402, 403, 404}
    assert not ids & {i for i, q, t in rated if t or not q}
    second = have("ngram_jaccard_join")
    assert sorted(second, key=str) == sorted(brute_kept(first), key=str) and not {200, 203, 206, 300, 301} & {i for i, _ in second}
    third = dict(have("suffix_array_dedup"))
    assert third == brute_cut(second) and len(third) == len(second) and len(third[401]) < len(dict(second)[401]) == len(dict(second)[401].encode())
    fourth = have("source_mixing")
    assert all(third[i] == t for i, t in fourth) and {i for i, _ in fourth} <= set(third) and max(Counter(i for i, _ in fourth).values()) <= 3
    pieces = Counter()
    for r in got["packing"]:
        pieces[r["doc_id"]] += r["length"]
    library = Tokenizer.from_file(vocabulary(packing.VOCABULARY))
    want = Counter()
    for i, t in fourth:
        want[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert pieces == want


def test_empty_documents_pass_and_without_labels_nothing_goes(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        assert d.count() == 0, name
    few = spark.createDataFrame([(1, "one text of words", "en", "s", 17), (2, None, None, None, None)], schema)
    assert corpus_pipeline.STAGES[0][1](spark, few, str(tmp_path)).count() == 2
