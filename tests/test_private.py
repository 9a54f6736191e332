"""What treating and scoring a table leaves in the work folder."""

import os
import threading

import pytest

import veilframe as vf
from people import COLUMNS, row
from veilframe.operators import scoring
from veilframe.session import scratch, stage, staged_inside

KEY = "id"
ROWS = [row(i) for i in range(48)]
GIVEN_UP = ["customer_id", "customer_name_ar", "customer_name_en", "national_id", "mobile", "email", "iban", "address_ar", "salary"]


@pytest.fixture(scope="module")
def people(spark):
    names = ", ".join(f"{c} string" for c in COLUMNS)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], f"{KEY} long, {names}")


@pytest.fixture(scope="module")
def found(people):
    return vf.detect(people, KEY)


def left_behind(spark, paths):
    """All cells, as text, of the tables that are still there."""
    cells = set()
    for path in paths:
        if os.path.isdir(path):
            cells |= {str(v) for r in spark.read.parquet(path).collect() for v in r}
    return cells


def originals():
    return {r[COLUMNS.index(c)] for r in ROWS for c in GIVEN_UP}


@pytest.mark.parametrize("profile", ["external", "internal"])
def test_no_original_is_stored(spark, people, found, profile):
    with staged_inside() as paths:
        result = vf.anonymize(people, vf.build_config(found, COLUMNS, profile), found, profile, KEY, salt="s")
        risk, utility = vf.assess_risk(result), vf.assess_utility(result)
    cells = left_behind(spark, paths)
    assert len(cells) > 100 and not cells & originals()
    assert not any(r[COLUMNS.index("national_id")] in c for r in ROWS for c in cells)
    assert risk.after < risk.before and 0 < utility.score < 100


def test_comparing_purposes_stores_codes_alone(spark, people, found):
    with staged_inside() as paths:
        vf.compare_profiles(people, found, COLUMNS, KEY, "s").collect()
    cells = left_behind(spark, paths)
    assert cells and all(c == "None" or c.lstrip("-").isdigit() for c in cells) and not cells & originals()


def test_pairs_are_brought_together_by_key(people, found):
    result = vf.anonymize(people.repartition(3), vf.build_config(found, COLUMNS, "external"), found, "external", KEY, salt="s")
    lazy = vf.anonymize(people, vf.build_config(found, COLUMNS, "external"), found, "external", KEY, salt="s", staged=False)
    columns = [KEY, *COLUMNS, *[f"{c}__before" for c in COLUMNS]]
    rows = lambda r: sorted(map(tuple, r.paired.select(columns).collect()))
    assert rows(result) == rows(lazy)
    assert {c: {k: v for k, v in x.items() if v is not None} for c, x in scoring.measure(result).items()} == {
        c: pytest.approx({k: v for k, v in x.items() if v is not None and k in scoring.measure(result)[c]}) for c, x in scoring.measure(lazy).items()}


def test_a_block_deletes_its_own_tables_only(spark):
    kept, ready, done = [], threading.Event(), threading.Event()

    def other():
        ready.wait()
        with staged_inside() as paths:
            stage(spark.range(3).toDF("x"), "other")
        kept.extend(paths)
        done.set()
    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark):
        with staged_inside() as own:
            stage(spark.range(3).toDF("x"), "own")
            ready.set()
            done.wait(60)
    thread.join()
    assert len(own) == len(kept) == 1 and not os.path.isdir(own[0]) and os.path.isdir(kept[0])
