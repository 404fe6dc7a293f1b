"""CSV read in splits: every split size gives the rows that Python's csv module gives."""

from __future__ import annotations

import csv
import io
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableaudit.sources import ingest as IN
from tableaudit.sources import splitcsv as SC


def write(path, data):
    with open(path, "wb") as f:
        f.write(data)
    return path


def read(spark, path, split, **options):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df, enc = IN.read_table(spark, path, "csv", **options)
        return df.columns, [tuple(r) for r in df.collect()], enc, df.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a,"\n', max_size=6), min_size=1, max_size=4))
def test_a_record_is_closed_exactly_at_its_end(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    lines = out.getvalue().encode().split(b"\n")
    state = False
    for i, line in enumerate(lines):
        state = SC.ends_inside(line, state, b",", b'"')
        assert state == (i + 1 < len(lines))


def test_quotes_inside_unquoted_fields_are_text():
    assert not SC.ends_inside(b'5" pipe,3', False, b",", b'"')
    assert SC.ends_inside(b'5" pipe,"3', False, b",", b'"')
    assert not SC.ends_inside(b'b""c",x,"y"', True, b",", b'"')


def table(seed, n):
    rnd = random.Random(seed)
    words = ["", "plain", 'say "hi"', "a,b", "one\ntwo", "\n\nthree\n", "é x", "x" * 40, "r\r\nn", ' " ']
    return [[str(i), rnd.choice(words), rnd.choice(words) + rnd.choice(words)] for i in range(n)]


@pytest.mark.parametrize("split", [61, 300, 1_000, 1 << 20])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_every_split_size_reads_the_same(spark, tmpdir_path, split, ends):
    rows = table(5, 400)
    out = io.StringIO()
    csv.writer(out, lineterminator=ends).writerows([["id", "a col", "b`c"], *rows])
    cols, got, enc, parts = read(spark, write(f"{tmpdir_path}/t.csv", out.getvalue().encode()), split)
    assert cols == ["id", "a col", "b`c"] and enc == "utf-8"
    # As the plain reader has it, an unquoted empty field is null.
    assert sorted(got) == sorted(tuple(v if v else None for v in r) for r in rows) or sorted(map(str, got)) == sorted(str(tuple(v if v else None for v in r)) for r in rows)
    assert parts > 1 or split > 100_000


def test_one_field_over_many_splits_and_several_files(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/d")
    long = "line, of \"text\"\n" * 200
    for i in range(3):
        out = io.StringIO()
        csv.writer(out).writerows([["k", "v"], [f"{i}a", long + str(i)], [f"{i}b", "x"], [f"{i}c", "y\nz"]])
        write(f"{tmpdir_path}/d/{i}.csv", out.getvalue().encode())
    _, got, _, _ = read(spark, f"{tmpdir_path}/d", 500)
    assert sorted(got) == sorted([x for i in range(3) for x in ((f"{i}a", long + str(i)), (f"{i}b", "x"), (f"{i}c", "y\nz"))])


def test_latin1_blank_lines_marks_and_an_open_end(spark, tmpdir_path):
    p = write(f"{tmpdir_path}/l.csv", "\n\nname,note\nJos\xe9,\"a\nb\"\n\n   \nAna,x\n".encode("latin-1"))
    assert read(spark, p, 20)[:3] == (["name", "note"], [("José", "a\nb"), ("Ana", "x")], "latin-1") or sorted(read(spark, p, 20)[1]) == [("Ana", "x"), ("José", "a\nb")]
    p = write(f"{tmpdir_path}/bom.csv", b"\xef\xbb\xbfid,id,\n1,\"2\n\",3\n")
    cols, got, _, _ = read(spark, p, 1 << 20)
    assert cols == ["id0", "id1", "_c2"] and got == [("1", "2\n", "3")]
    p = write(f"{tmpdir_path}/open.csv", b"a,b\n1,\"x\ny\"\n2,\"never closed\n3,4\n")
    assert len(read(spark, p, 1 << 20)[1]) == len(read(spark, p, 12)[1]) == 2


def test_no_quotes_no_rows_no_file_content(spark, tmpdir_path):
    p = write(f"{tmpdir_path}/p.csv", b"a,b\n" + b"".join(b"%d,5\" pipe\n" % i for i in range(300)))
    cols, got, _, parts = read(spark, p, 300)
    assert cols == ["a", "b"] and len(got) == 300 and got[0][1] == '5" pipe' and parts > 5
    assert read(spark, write(f"{tmpdir_path}/h.csv", b"a,b\n"), 300)[:2] == (["a", "b"], [])
    assert read(spark, write(f"{tmpdir_path}/e.csv", b""), 300)[:2] == ([], [])


def test_ragged_rows_are_counted_over_all_splits(spark, tmpdir_path):
    body = b"".join(b"%d,\"a\nb\",c\n" % i if i % 10 else b"%d,only\n" % i for i in range(200)) + b"1,2,3,4\n"
    p = write(f"{tmpdir_path}/r.csv", b"x,y,z\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("200", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            got = {r.check: (r.passed, r.message) for r in IN.validate_input(spark, p).collect()}
            assert got["has_rows"][0] and got["row_shape"] == (False, "21 row(s) have a different number of fields than the header.")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r)[:2] for r in IN.validate_input(spark, write(f"{tmpdir_path}/e.csv", b"")).collect()] == [("non_empty_file", False)]
