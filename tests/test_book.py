"""Numbers of pseudonyms that go on from table to table."""

import os

import pytest

import veilframe as vf
from tests.people import COLUMNS, ROWS
from veilframe.operators.book import PseudonymBook
from veilframe.plans.anonymize import numbered_columns
from veilframe.sources import writers
from veilframe.streaming import mask_stream


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, job string").repartition(3)


def held(book):
    return {(r.column, r.digest): r.number for r in book.numbers().collect()}


def test_numbers_go_on(spark, tmp_path):
    book = PseudonymBook(spark, str(tmp_path / "book"), "s")
    first = table(spark, [(3, "b", "x"), (1, "a", "x"), (2, "a", None), (4, " ", "y")])
    book.extend(first, "id", ["name", "job"])
    one = held(book)
    assert sorted(one.values()) == [1, 1, 2, 2]
    book.extend(first, "id", ["name", "job"])
    assert held(book) == one                                        # nothing new, nothing numbered
    later = table(spark, [(1, "c", "y"), (2, "a", "z"), (3, "b", "z"), (4, "d", None)])
    book.extend(later, "id", ["name", "job"])
    assert {k: v for k, v in held(book).items() if k in one} == one and sorted(held(book).values()) == [1, 1, 2, 2, 3, 3, 4]
    rows = {r.id: (r["__number_name"], r["__number_job"]) for r in book.attach(later, "id", ["name", "job"], 0).collect()}
    assert rows == {1: (3, 2), 2: (1, 3), 3: (2, 3), 4: (4, None)}
    assert rows == {r.id: (r["__number_name"], r["__number_job"]) for r in PseudonymBook(spark, str(tmp_path / "book"), "s").attach(later, "id", ["name", "job"]).collect()}
    assert {len(d) for _, d in held(book)} == {64}                  # the book tells no value


def test_an_entry_is_made_once_and_again_after_a_failure(spark, tmp_path):
    path = str(tmp_path / "book")
    book = PseudonymBook(spark, path, "s")
    book.extend(table(spark, [(1, "a", "x")]), "id", ["name"], "batch-1")
    book.extend(table(spark, [(1, "q", "x")]), "id", ["name"], "batch-1")
    assert len(held(book)) == 1
    os.makedirs(f"{path}/batch-2")                                  # a write that did not end
    with open(f"{path}/batch-2/part-0.parquet", "w") as f:
        f.write("half")
    book.extend(table(spark, [(1, "b", "x"), (2, "c", "x")]), "id", ["name"], "batch-2")
    assert sorted(held(book).values()) == [1, 2, 3] and book.entries() == ["batch-1", "batch-2"]
    empty = PseudonymBook(spark, str(tmp_path / "other"), "s")
    empty.extend(table(spark, []), "id", ["name"])
    assert held(empty) == {} and empty.attach(table(spark, []), "id", ["name"]).count() == 0


def test_a_stream_goes_on_from_a_table(spark, tmp_path):
    people = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], ", ".join(["row_id bigint", *[f"{c} string" for c in COLUMNS]]))
    found = vf.detect(people, "row_id")
    config = vf.build_config(found, COLUMNS, "internal")
    book = PseudonymBook(spark, str(tmp_path / "book"), "s")
    result = vf.anonymize(people.where("row_id < 20"), config, found, "internal", "row_id", salt="s", book=book)
    writers.save_run(str(tmp_path / "run"), found, config, result, vf.assess_risk(result), vf.assess_utility(result))
    profile, treatments = writers.load_treatments(spark, str(tmp_path / "run"))
    names = numbered_columns(treatments, result.profile)
    assert names and len(book.entries()) == 1
    people.repartition(4).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(people.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    write = lambda: mask_stream.write_treated(arriving, treatments, profile, "s", "row_id", book, str(tmp_path / "out"), str(tmp_path / "state")).start().awaitTermination()
    write()
    out = {r.row_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(out) == 48 and len(book.entries()) == 3
    before = {r.row_id: r for r in result.data.collect()}
    assert all(out[i][c] == before[i][c] for i in before for c in names)
    for c in names:                                                 # one pseudonym for each name, one name for each pseudonym
        pairs = {(ROWS[i][COLUMNS.index(c)], r[c]) for i, r in out.items()}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    write()                                                         # nothing has arrived since
    assert spark.read.parquet(str(tmp_path / "out")).count() == 48
    with pytest.raises(ValueError, match="book"):
        mask_stream.treated_stream(arriving, treatments, profile, "s", "row_id")
