import re

import pytest

from tabulens.operators import blocks, headers
from tabulens.sources import formats
from tests.conftest import SAMPLE, lines_of

CASES = {
    "standard": "sku,seen_on,weight,grade,remark\n11,2024-03-01 08:00:00,12.5,B,as usual\n12,2024-03-01 08:10:00,13.0,B,as usual\n13,2024-03-02 08:00:00,20.5,C,heavier\n",
    "comments": "# exported by hand\n# third of March\nkey,city,people,state\n1,Ulm,120,open\n2,Bonn,330,shut\n3,Trier,110,open\n",
    "numeric": "7,310,5.25,0.5\n8,320,6.25,0.6\n9,330,7.25,0.7\n10,340,8.25,0.8\n",
    "identifiers": "order_id,shippedAt,net_price,warehouseCode\no71,2024-05-01,12.00,north\no72,2024-05-02,13.00,south\no73,2024-05-03,14.00,west\n",
    "chinese": "编号,名称,数量,省份,日期\n1,苹果,30,四川,2024-02-01\n2,梨,40,云南,2024-02-02\n3,桃,50,湖南,2024-02-03\n",
    "single": "P,Q,R,S\n3,1,4,1\n5,9,2,6\n",
    "years": "Region,2019,2020,2021,Change\nNorth,10,12,15,50%\nSouth,8,9,10,25%\n",
    "special": "item-no,made_on,net$price,vat%,memo#2\n1,2024-07-01,10.00,19,first\n2,2024-07-02,20.00,7,second\n",
    "blank_first": "\n\nkey,city,people\n1,Ulm,120\n2,Bonn,330\n",
    "tsv": "key\tcity\tpeople\tstate\n1\tUlm\t120\topen\n2\tBonn\t330\tshut\n",
    "semicolon": "key;fruit;cost;pieces\n1;Pear;2,50;12\n2;Plum;0,80;25\n",
    "quoted": '"Order No","Ship To","Contact Mail"\n1,"Ann Lee","ann@mail.test"\n2,"Bob Ray","bob@mail.test"\n',
    "sample": SAMPLE,
}

# file -> delimiter, header row
EXPECTED = {
    "standard": (",", 0), "comments": (",", 2), "numeric": (",", 0), "identifiers": (",", 0), "chinese": (",", 0), "single": (",", 0),
    "years": (",", 0), "special": (",", 0), "blank_first": (",", 0), "tsv": ("\t", 0), "semicolon": (";", 0), "quoted": (",", 0), "sample": (",", 0),
}
SAMPLE_SCORES = [0.84, 0.4243, 0.4213, 0.4166, 0.5327, 0.5713, 0.19, 0.2863]


def detect(spark, mode):
    head = formats.head_lines(lines_of(spark, CASES))
    sniffed = formats.sniff_delimiter(head, mode)
    ranked = headers.rank_candidates(headers.score_candidates(head, mode)).persist()
    result = headers.detection_result(headers.select_header(ranked))
    delimiters = {r.file_id: r.delimiter for r in sniffed.collect()}
    scores = {}
    for r in ranked.collect():
        scores.setdefault(r.file_id, {})[r.row] = r
    ranked.unpersist()
    return delimiters, scores, {r.file_id: r for r in result.collect()}


@pytest.fixture(scope="module")
def compat(spark):
    return detect(spark, "compat")


@pytest.fixture(scope="module")
def robust(spark):
    return detect(spark, "robust")


@pytest.mark.parametrize("name", list(EXPECTED))
def test_header_and_delimiter(compat, robust, name):
    for delimiters, _, result in [robust] if name == "comments" else [robust, compat]:
        assert (delimiters[name], result[name].header_row) == EXPECTED[name]


def test_sample_scores(compat):
    assert [compat[1]["sample"][i].score for i in range(8)] == pytest.approx(SAMPLE_SCORES, abs=6e-4)


def test_robust_drops_comment_candidates(robust):
    _, scores, result = robust
    assert sorted(scores["comments"]) == [2, 3, 4, 5]
    assert max(scores["comments"].values(), key=lambda r: r.score).row == 2
    assert result["comments"].selection_reason == "first_row_is_comment"


def test_numeric_rows_are_penalised(compat):
    _, scores, _ = compat
    assert all(r.data_row_penalty > 0 for r in scores["numeric"].values())


def test_sample_order_and_result(compat):
    _, scores, result = compat
    assert [r.row for r in sorted(scores["sample"].values(), key=lambda r: r.rank)] == [0, 5, 4, 1, 2, 3, 7, 6]
    r = result["sample"]
    assert (r.confidence, r.confidence_score, r.needs_review) == ("HIGH", 0.84, False)
    assert (r.review_reason, r.selection_reason) == ("confident", "first_row_is_best")
    assert [c.row for c in r.candidate_summary] == [0, 5, 4]
    assert [c.score for c in r.candidate_summary] == [0.84, 0.5713, 0.5327]


def test_years_keep_first_row(compat):
    _, _, result = compat
    assert result["years"].selection_reason.startswith("small_gap_")
    assert result["years"].confidence == "UNCERTAIN" and result["years"].needs_review


def test_wider_rows_fail_to_parse_and_index_columns_are_skipped(spark):
    texts = {"ragged": "a,b\n1,2\n1,2,3\n", "indexed": "a,b\n9,1,2\n8,3,4\n"}
    head = formats.head_lines(lines_of(spark, texts))
    rows = {(r.file_id, r.row): r for r in headers.score_candidates(head).collect()}
    assert rows["ragged", 0].reason == "parse_failed" and rows["ragged", 0].score == 0.0
    assert rows["indexed", 0].reason == "scored"
    # columns a = (1, 3) and b = (2, 4): the leading 9 and 8 are an index
    assert rows["indexed", 0].stability == pytest.approx(0.0)


def test_header_by_consistency(spark):
    head = formats.head_lines(lines_of(spark, {"sample": CASES["standard"], "one": "a\nb\nc\n"}))
    rows = {r.file_id: r for r in headers.header_by_consistency(head).collect()}
    assert rows["one"].header_row == 0 and rows["one"].score == -1.0
    assert 0 <= rows["sample"].score <= 1


def test_files_are_dealt_to_more_tasks_than_a_shuffle_cut_by_bytes_has(spark):
    """Judging a file costs more than its bytes tell; grouping by file afterwards needs no other exchange."""
    lines = lines_of(spark, {f"f{i}": CASES["standard"] for i in range(40)})
    found = headers.detect_headers(formats.head_lines(lines))
    assert {r.header_row for r in found.collect()} == {0}
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("Initial Plan")[-1].splitlines() if "Exchange " in line]
    assert len(exchanges) == 2 and sum("hashpartitioning(file_id" in x and "8), REPARTITION_BY_NUM" in x for x in exchanges) == 1


def test_a_number_is_read_once(spark):
    """Cells that only look like numbers, or hold commas, spaces or separated digits, count as before; each is cast once."""
    texts = {"n": "name,value\na,\" 1,500 \"\nb,1_000\nc,nan\nd,inf\ne,\n", "w": "name;value\na;1,500\nb;2,500\nc;NA\n"}
    scored = headers.score_candidates(formats.head_lines(lines_of(spark, texts)))
    rows = {(r.file_id, r.row): r for r in scored.collect()}
    # 1500 and 2500 in one column: a spread of 500; 1500 alone: none.
    assert rows["w", 0].stability == 0.0 and rows["n", 0].stability == 1.0
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"digits as double\)", plan)) == 1


def test_candidates_are_counted_once_and_without_ranking_rows(spark, monkeypatch):
    """Cells are counted as flat arrays, once, however files are put together; a file's candidates need no sort of rows."""
    ragged = {"ragged": "a,b\n1,2\n1,2,3\n1,2\n1,2\n", "indexed": "a,b\n9,1,2\n8,3,4\n", "remarks": "# a\n# b\n", "blank": " , \n", "late": "# a\n" * 9 + "a,b\n1,2\n"}
    head = formats.head_lines(lines_of(spark, CASES | ragged))
    for mode in ("robust", "compat"):
        steps = headers.detection_result(headers.select_header(headers.rank_candidates(headers.score_candidates(head, mode))))
        want = sorted(map(repr, steps.collect()))
        found = headers.detect_headers(head, mode)
        assert sorted(map(repr, found.collect())) == want and len(want) == len(CASES | ragged) - (mode == "robust")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "score" not in "".join(x for x in plan.splitlines() if " Window " in x)
        monkeypatch.setattr(blocks, "TOGETHER", 7)
        assert sorted(map(repr, headers.detect_headers(head, mode).collect())) == want
        monkeypatch.undo()


def test_a_filter_on_decisions_does_not_judge_twice(spark):
    """Spark may push a condition below the exchange, but not together with the judging that it depends on."""
    found = headers.detect_headers(formats.head_lines(lines_of(spark, CASES))).where("header_line_no >= 0 AND delimiter IS NOT NULL")
    assert found.count() == len(CASES)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
