"""Files of all kinds in one folder, and quoted line breaks across the borders of blocks, against the csv module."""

import csv
import io
import random

import pytest

from tessera.sources import landing, quoted


def plainly(text, sep):
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))
    names = landing.clean_header(rows[0])
    cells = [[c.strip() for c in r][: len(names)] + [""] * (len(names) - len(r)) for r in rows[1:]]
    return names, [tuple(r) for r in cells if any(r)]


def made(rng, n, sep):
    cell = lambda: rng.choice(["", "plain", ' stray " sign', '"a\n\nb"', f'"x{sep}y"', '"say ""no""\nthen"', '"long\n' + "line\n" * rng.randint(0, 40) + '"', '"tail"rest', "é", '"\r\n"', '""'])
    return "\n".join([sep.join(["id", "note", "more"]), *(sep.join([str(i), cell(), cell()][: rng.choice([3, 3, 3, 2])]) for i in range(n))]) + "\n"


@pytest.mark.parametrize(("few", "newline"), [(10**6, "\n"), (0, "\n"), (10**6, "\r\n")])
def test_blocks_take_their_lines_apart(spark, tmp_path, monkeypatch, few, newline):
    monkeypatch.setattr(quoted, "FEW", few)
    rng = random.Random(few)
    text = made(rng, 400, ",")
    (tmp_path / "q.csv").write_bytes(text.replace("\r\n", "\n").replace("\n", newline).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = landing.read_delimited(spark, str(tmp_path / "q.csv"), placed=True)
        assert spark.read.text(str(tmp_path / "q.csv")).rdd.getNumPartitions() > 10
        rows = landing.in_file_order(got).orderBy("row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    names, want = plainly(text.replace("\r\n", "\n"), ",")
    assert [tuple(r)[:3] for r in rows] == want and [r.row_number for r in rows] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("opened", [False, True])
def test_state_behind_a_line(opened):
    rng = random.Random(1)
    for _ in range(4000):
        line = "".join(rng.choice('"",ab ') for _ in range(rng.randint(0, 9)))
        # One more line tells: a cell that is open swallows it.
        rows = list(csv.reader(io.StringIO(('"' if opened else "") + line + "\nz\n", newline="")))
        assert quoted.open_after(line, ",", opened) == (len(rows) == 1 if line or opened else False), line


def test_each_file_by_its_own(spark, tmp_path):
    files = {
        "utf.csv": "id,name\n1,José\n2,� sign\n".encode(),
        "latin.csv": "id,name\n3,José\n".encode("latin-1"),
        "pipe.csv": "id|name\n4|a,b\n5|Zoë\n".encode(),
        "tab.csv": "id\tname\textra\n6\tsix\tmore\n".encode(),
        "semi.csv": 'id;name\n7;"two\nlines; one"\n8;plain\n'.encode("latin-1"),
        "bom.csv": "﻿id,name\r\n9,nine\r\n".encode(),
        "empty.csv": b"",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.id: (r.name, r.extra) for r in landing.read_delimited(spark, str(tmp_path)).collect()}
    want = {"1": "José", "2": "� sign", "3": "José", "4": "a,b", "5": "Zoë", "6": "six", "7": "two\nlines; one", "8": "plain", "9": "nine"}
    assert got == {k: (v, "more" if k == "6" else "") for k, v in want.items()}
