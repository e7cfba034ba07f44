"""Rows with null or repeated doc_ids are told apart by their texts."""

from meshlark.llm import decontam, neardup


def text(k, n=60):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_null_and_repeated_ids_in_classes(make_docs):
    rows = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(4)), (None, text(5)), (9, text(5)), (None, text(5)), (7, ""), (7, "..."), (None, "")]
    docs = make_docs([(*r, "en", "a") for r in rows])
    kept = sorted(((r.doc_id, r.text) for r in neardup.drop_near_duplicates(docs).collect()), key=repr)
    want = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (9, text(5)), (7, ""), (7, "..."), (None, "")]
    assert kept == sorted(want, key=repr)
    classes = neardup.near_duplicates(docs).collect()
    assert len(classes) == len(rows)
    assert sorted((r.doc_id, r.class_id) for r in classes if r.doc_id in (8, 9)) == [(8, 7), (9, 9)]
    assert sorted(r.class_id or -1 for r in classes if r.doc_id is None) == [-1, -1, -1, 9, 9]


def test_null_and_repeated_ids_of_leaks(spark, make_docs):
    table = spark.createDataFrame([(1, text(1, 20))], "item_id long, text string")
    rows = [(None, text(1)), (None, text(2)), (7, text(1)), (7, text(3)), (None, None), (7, None), (7, text(1)), (8, "")]
    docs = make_docs([(*r, "en", "a") for r in rows])
    left = decontam.drop_leaks(docs, table)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([r for r in rows if r[1] != text(1)], key=repr)
