"""The pipeline, stage by stage on its own input, against plain versions."""

import public_tokenizers as P
import pytest
from fixtures import edited, prose, words
from test_pairs import jaccard_by_force
from tokenizers import Tokenizer

import corpus_pipeline as cp
from facetline.session import Scratch


@pytest.fixture(scope="module")
def source():
    p = prose(900, 80)
    rows = [(i, prose(1000 + i, 120)) for i in range(25)]
    rows += [(100, rows[3][1]), (101, edited(rows[4][1], 3, 60)), (102, prose(2000, 60) + " " + p), (103, prose(2001, 70) + "\n" + p + " mail jo.doe9@mail.example.com"), (104, "mail jo.doe9@mail.example.com " + prose(2002, 90))]
    rows += [(200, " ".join(w + "&&&" for w in prose(2003, 90).split())), (201, "too short"), (202, None), (203, ""), (3, rows[3][1])]
    return rows


def test_stages(spark, source, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in source], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, scratch, seen = docs.columns, Scratch(spark, "t"), []
    for _, stage in cp.STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
        seen.append([(r.doc_id, r.text) for r in docs.collect()])
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    rules, near, passages, private = seen
    assert sorted(i for i, _ in rules) == sorted(i for i, _ in source if i < 200)
    assert sorted(i for i, _ in near) == sorted({i for i, _, c in jaccard_by_force(rules) if i == c})
    before, after = dict(near), dict(passages)
    assert after.keys() == before.keys() and {i for i in after if after[i] != before[i]} == {103}
    assert words(after[103]) == words(before[103])[:70] + words(before[103])[150:]
    final = dict(private)
    assert {i for i in final if final[i] != after[i]} == {103, 104}
    fake = final[104].split(" ")[1]
    assert "jo.doe9" not in fake and fake in final[103]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    packed = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == sorted((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in private)
    whole = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.length, r.ids_crc32) for r in packed)


def test_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "private data", "best-fit packing"]


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names
