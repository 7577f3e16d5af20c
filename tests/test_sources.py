import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tabulens.sources import delimited, formats, heads, records, rows
from tests.conftest import SAMPLE


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sample_mixed.csv").write_text(SAMPLE)
    (root / "a b.csv").write_bytes("名称;数量\r\n苹果;1\r\n香蕉;2\r\n".encode("gbk"))
    (root / "bom.csv").write_bytes("﻿name,größe\nx,1\n".encode())
    (root / "latin.csv").write_bytes("name,value\n\xff\xe9,1\n".encode("latin1"))
    (root / "dup.csv").write_text("# note\na,a,,a\n1,2,3,4\n\n5,6,NA,\n")
    return root


@pytest.fixture(scope="module")
def head(spark, folder):
    return heads.read_heads(spark, str(folder))


def name_of(file_id):
    return file_id.rsplit("/", 1)[-1]


def test_encodings(head):
    found = {name_of(r.file_id): r.encoding for r in head.select("file_id", "encoding").distinct().collect()}
    assert found == {
        "sample_mixed.csv": "ascii", "a%20b.csv": "gbk", "bom.csv": "utf-8-sig", "latin.csv": "latin1", "dup.csv": "ascii",
    }


def test_cut_character():
    data = "ü".encode() * 10
    assert heads.encoding_of(data[:-1], cut=True) == "utf-8"
    assert heads.encoding_of(data, cut=True) == "utf-8"
    assert heads.encoding_of("a中".encode()[:-1], cut=True) == "ascii"


def test_scan_of_mixed_files(spark, folder):
    found, decisions, _ = delimited.scan_files(spark, str(folder))
    scanned = {}
    for r in found.orderBy("_row_idx").collect():
        assert r._row_idx == len(scanned.setdefault(name_of(r.file_id), []))
        scanned[name_of(r.file_id)].append((r.names, r.cells))
    assert scanned["a%20b.csv"] == [(["名称", "数量"], ["苹果", "1"]), (["名称", "数量"], ["香蕉", "2"])]
    assert scanned["bom.csv"] == [(["name", "größe"], ["x", "1"])]
    assert scanned["latin.csv"] == [(["name", "value"], ["ÿé", "1"])]
    names = ["a", "a__dup1", "Unnamed: 2", "a__dup2"]
    assert scanned["dup.csv"] == [(names, ["1", "2", "3", "4"]), (names, ["5", "6", None, None])]
    assert len(scanned["sample_mixed.csv"]) == 7


def test_number_lines_over_many_splits(spark, tmp_path):
    (tmp_path / "x.csv").write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "y.csv").write_text("".join(f"line {i}\n" for i in range(700)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = delimited.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        wrong = rows.number_lines(lines).where(F.col("line") != F.concat(F.lit("line "), "row")).count()
        ordered = formats.head_lines(lines, 10).orderBy("file_id", "row").select("line").collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert wrong == 0
    assert [r.line for r in ordered] == [f"line {i}" for i in range(10)] * 2


def scanned(spark, folder, texts, **options):
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_text(text)
    scan = delimited.scan_files(spark, str(folder), **options)
    rows = {}
    for r in scan.rows.orderBy("file_id", "_row_idx").collect():
        rows.setdefault(r.file_id.rsplit("/", 1)[1], []).append(r)
    return rows, {r.file_id.rsplit("/", 1)[1]: r for r in scan.decisions.collect()}, scan.skipped.collect()


def test_names_come_from_the_whole_header_line(spark, tmp_path):
    """Headers that are longer than the head, with and without an index, and one that ends where the head does."""
    names = [f"measured_column_{i}" for i in range(60)]
    line = ",".join(str(i) for i in range(60))
    texts = {"wide.csv": ",".join(names) + f"\n{line}\n{line}\n", "index.csv": ",".join(names) + f"\nx,{line}\ny,{line}\n", "short.csv": "a,b\n1,2\n"}
    rows, decisions, _ = scanned(spark, tmp_path / "in", texts, sniff_bytes=400)
    for name in ("wide.csv", "index.csv"):
        assert decisions[name].names == names
        assert [r.cells for r in rows[name]] == [[str(i) for i in range(60)]] * 2
    assert [r["_index"] for r in rows["index.csv"]] == [["x"], ["y"]] and rows["short.csv"][0].cells == ["1", "2"]


def test_nothing_vanishes(spark, tmp_path):
    """A wide row keeps its leading cells and its rest; one shift per file; lines above the header are listed."""
    body = "".join(f"{i},n{i},{i * 2}\n" for i in range(30))
    texts = {
        "ragged.csv": "id,name,amount\n" + body + "31,x,7,extra,more\n32,y\n",
        "indexed.csv": "name,amount\n" + "".join(f"{i},a{i},{i}\n" for i in range(30)) + "30,c,3,z\n31,d\n",
        "remarks.csv": "# made by hand\n# twice\nid,name,amount\n1,a,2\n2,b,3\n",
    }
    rows, decisions, skipped = scanned(spark, tmp_path / "in", texts)
    last = rows["ragged.csv"][-2:]
    assert (last[0].cells, last[0]["_extra"], last[0]["_index"]) == (["31", "x", "7"], ["extra", "more"], [])
    assert (last[1].cells, last[1]["_extra"]) == (["32", "y", None], [])
    assert [(r["_index"], r.cells, r["_extra"]) for r in rows["indexed.csv"]][29:] == [
        (["29"], ["a29", "29"], []), (["30"], ["c", "3"], ["z"]), (["31"], ["d", None], []),
    ]
    assert sorted((r.line, r.reason) for r in skipped) == [("# made by hand", "above_header"), ("# twice", "above_header")]
    for name, text in texts.items():
        assert len(text.splitlines()) == 1 + len(rows[name]) + sum(r.file_id.endswith(name) for r in skipped)


def record_rows(text, delimiter=","):
    """What a reader that knows quotes makes of a text: rows of fields and the lines each took, in order."""
    rows, last = [], 0
    reader = csv.reader(io.StringIO(text), delimiter=delimiter, strict=False)
    for row in reader:
        if row and (len(row) > 1 or row[0].strip()):
            rows.append((row, reader.line_num - last))
        last = reader.line_num
    return rows


@pytest.mark.parametrize("split", ["60", "100000"])
def test_records_of_several_lines(spark, tmp_path, split):
    """Quoted line breaks, also with blank lines, quotes and other records' signs inside, over splits of any size."""
    rng = random.Random(5)

    def field(i, sep):
        kind = rng.randrange(8)
        return {0: f'"two\nlines {i}"', 1: f'"a ""quoted"" {i}\n\nx{sep}y\n"', 2: f'"one{sep} {i}"', 3: f'{i}" pipe', 4: '"\n"', 5: '""'}.get(kind, f"plain{i}")

    def body(n, sep):
        return "".join(sep.join([str(i), field(i, sep), field(i + 1, sep)]) + "\n" for i in range(n))

    texts = {
        "commas.csv": "id,name,note\n" + body(25, ","), "bars.csv": "id|name|note\n" + body(20, "|"), "plain.csv": "id,name,note\n1,a,b\n\n2,c,d\n",
        "long.csv": "id,name,note\n1,a,b\n2,\"" + "line of a very long field\n" * 15 + "\",c\n3,d,e\n", "header.csv": 'id,"first\nname",note\n' + body(9, ","),
        "never.csv": "id,name,note\n1,a,b\n2,c,d\n3,\"open,e\n4,f,g\n",
    }
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows, decisions, skipped = scanned(spark, tmp_path / "in", texts)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    for name, text in texts.items():
        if name == "never.csv":  # the quote stays open, so lines stand for themselves
            assert [r["_lines"] for r in rows[name]] == [1] * 4 and rows[name][3].cells == ["4", "f", "g"]
            continue
        (header, taken), *data = record_rows(text, decisions[name].delimiter)
        assert decisions[name].names == header
        assert [r["_row_idx"] for r in rows[name]] == list(range(len(data)))
        assert [r["_lines"] for r in rows[name]] == [n for _, n in data]
        for r, (want, _) in zip(rows[name], data):
            assert [c or "" for c in r.cells] == ["" if x in ("", "NA") else x for x in want]
    assert skipped == []


def test_quote_states_are_those_of_a_reader(spark):
    """Every line of random quotes and signs, from either state, against a machine that goes character by character."""

    def ends(line, inside):
        state = "in" if inside else "start"
        for i, c in enumerate(line):
            if state == "in":
                state = "close" if c == '"' else "in"
            elif state == "close" and c == '"':
                state = "in"
            elif c == ",":
                state = "start"
            elif state == "start" and c == '"':
                state = "in"
            else:
                state = "field"
        return state == "in"

    rng = random.Random(6)
    lines = ["".join(rng.choice('",,ab') for _ in range(rng.randrange(9))) for _ in range(1500)]
    m = records.quote_map(F.col("line"), F.lit(","))
    for r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", m.alias("m")).collect():
        assert (r.m.outside, r.m.inside) == (ends(r.line, False), ends(r.line, True)), r.line
