"""Hand-computed cases and brute-force comparisons on small fixtures."""

from __future__ import annotations

import datetime as dt
import random
import statistics
import time
from decimal import Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from bizdocs.functions import dates as D
from bizdocs.functions import numbers as N
from bizdocs.functions import similarity as S
from bizdocs.functions import text as T
from bizdocs.operators import dictionary as DI
from bizdocs.operators import layout as Y
from bizdocs.operators import line_items as L
from bizdocs.operators import match as M
from bizdocs.operators import rank_join
from bizdocs.operators import merge as G
from bizdocs.operators import ordering as O
from bizdocs.operators import resolve as R
from bizdocs.operators import text_tables as X
from bizdocs.operators import upsert as U
from bizdocs.plans import export as E
from bizdocs.plans import report as P
from bizdocs.sources import readers as RD
from bizdocs.streaming import jobs as J


def one(spark, value, *cols):
    row = spark.createDataFrame([(value,)], "t string").select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


# --- functions ---------------------------------------------------------------

@pytest.mark.parametrize("raw, key", [
    ("스테인리스 304", "sus304"), ("SUS 3O4 2.0T", "sus3042t"), ("STS-304 판재", "sus304plate"), ("와샤 M8", "와셔m8"), ("", ""), (None, ""),
])
def test_normalize_item_text(spark, raw, key):
    assert one(spark, raw, T.normalize_item_text("t")) == key


def test_two_item_normalisers_differ(spark):
    assert one(spark, "스텐 철판", T.normalize_item_text("t"), T.normalize_item_text_search("t")) == ("스텐plate", "sus철판")


@pytest.mark.parametrize("raw, want", [("(주) 한빛", "한빛"), ("㈜가나 ", "가나"), ("주식 A", "식a")])
def test_normalize_party(spark, raw, want):
    assert one(spark, raw, T.normalize_party("t")) == want


@pytest.mark.parametrize("raw, loose, strict, business", [
    ("₩1,234.50", "1234.5000", "1234.5000", "1234.5000"), ("약 3개", "3.0000", None, "3.0000"), ("1.234.567", "1.2340", None, "1234567.0000"),
    ("12 x 34.5", "12.0000", None, "34.5000"), ("2024-01-02", "2024.0000", None, None), ("없음", None, None, None),
])
def test_decimals(spark, raw, loose, strict, business):
    got = one(spark, raw, N.loose_decimal("t"), N.strict_decimal("t"), N.business_decimal("t"))
    assert [None if v is None else str(v) for v in got] == [loose, strict, business]


@pytest.mark.parametrize("raw, want", [
    ("납기 2024년 3월 5일", "2024-03-05"), ("on 03/05/2024", "2024-03-05"), ("20240305", "2024-03-05"), ("March 5, 2024", "2024-03-05"), ("13.05.24", "2013-05-24"), ("none", None), ("2024-13-45", None),
])
def test_extract_date(spark, raw, want):
    got = one(spark, raw, D.extract_date("t"))
    assert (got and got.isoformat()) == want


def test_repair_date(spark):
    assert one(spark, "20248305", D.repair_date("t")) == "2024-03-05"
    assert one(spark, "20249999", D.repair_date("t")) == "2024-09-09"  # 99 reads back as 09 in both places
    assert one(spark, "20241147", D.repair_date("t")) is None


def test_ranges():
    assert D.resolve_range(year=2024, month=12) == (dt.date(2024, 12, 1), dt.date(2025, 1, 1), "month")
    assert D.resolve_range(dt.date(2024, 1, 3), dt.date(2024, 1, 3))[:2] == (dt.date(2024, 1, 3), dt.date(2024, 1, 4))
    with pytest.raises(ValueError):
        D.resolve_range(dt.date(2024, 1, 3), dt.date(2024, 1, 1))
    assert D.range_label(dt.date(2024, 1, 1), dt.date(2024, 2, 1), "month") == "2024-01-01 ~ 2024-01-31 (월)"


def test_merge_flags_ignore_case(spark):
    df = spark.createDataFrame([(["A b", "x"], ["a  B", None, "y"])], "p array<string>, q array<string>")
    assert df.select(T.merge_flags("p", "q", ignore_case=True)).first()[0] == ["A b", "x", "y"]


def test_similarity_follows_sequence_matcher():
    assert S.ratio("abcd", "bcde") == SequenceMatcher(None, "abcd", "bcde").ratio()
    assert S.jamo("각a") == "ㄱㅏㄱa" and S.jamo("가") == "ㄱㅏ_"
    assert S.name_similarity("볼트", "육각볼트") == 0.88 and S.name_similarity("", "x") == 0.0
    assert S.name_similarity("플레이트", "플래이트") == 0.88  # one vowel off
    assert S.name_similarity("abcdef", "abcxef") == S.window_ratio("abcdef", "abcxef")


def _words(rng, n, alphabet="abc", lo=1, hi=14):
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi))) for _ in range(n)})


@pytest.mark.parametrize("threshold", [0.76, 0.82])
def test_ratio_candidates_miss_nothing(spark, threshold):
    rng = random.Random(5)
    a, b = _words(rng, 60), _words(rng, 60, "abcd")
    left, right = (spark.createDataFrame([("t", w) for w in ws], "k string, text string") for ws in (a, b))
    got = {(r["a"], r["b"]) for r in M.ratio_candidates(left, right, threshold, ["k"]).collect()}
    want = {(x, y) for x in a for y in b if SequenceMatcher(None, x, y).ratio() >= threshold}
    assert want <= got


def test_contained_pairs(spark):
    rng = random.Random(7)
    a, b = _words(rng, 50, "ab", 2, 5), _words(rng, 50, "ab", 4, 12)
    frame = lambda ws: spark.createDataFrame([("t", w) for w in ws], "dictionary_type string, text string")
    got = {(r["a"], r["b"]) for r in DI.contained_pairs(frame(a), frame(b)).collect()}
    assert got == {(x, y) for x in a for y in b if len(x) >= 3 and x in y and x != y}


def test_suggest_against_brute_force(spark):
    rng = random.Random(11)
    names = _words(rng, 40, "abcde", 4, 10)
    d = spark.createDataFrame([("party", n.upper(), n, "s", "f", "e", i, str(i)) for i, n in enumerate(names)],
                              "dictionary_type string, canonical string, normalized string, source string, field string, evidence string, rank int, order_key string")
    d = d.withColumn("canonical", F.concat("canonical", F.lit("zz")))
    values = _words(rng, 40, "abcde", 4, 10) + names[:5]
    v = spark.createDataFrame([("party", x) for x in values], "dictionary_type string, value_norm string")
    got = {r["value_norm"]: (r["canonical"], round(r["confidence"], 3)) for r in DI.best_entry(DI.score_values(v, d)).collect()}

    def score(x, y):
        return 1.0 if x == y else 0.9 if x in y or y in x else SequenceMatcher(None, x, y).ratio()

    want = {}
    for x in set(values):
        best = max(((round(score(x, n), 3), -i) for i, n in enumerate(names) if score(x, n) >= 0.76), default=None)
        if best:
            want[x] = (names[-best[1]].upper() + "zz", best[0])
    assert got == want


# --- ordering ------------------------------------------------------------------

def test_number_rows_splits_hot_groups(spark):
    rng = random.Random(1)
    rows = [(1, rng.randint(0, 10**9)) for _ in range(3000)] + [(k, i) for k in range(2, 6) for i in range(7)]
    rows = list(set(rows))
    df = spark.createDataFrame(rows, "g int, o long")
    got = {(r["g"], r["o"]): r["n"] for r in O.number_rows(df, "g", "o", "n").collect()}
    for g in {r[0] for r in rows}:
        assert [got[(g, o)] for o in sorted(o for h, o in rows if h == g)] == list(range(1, sum(h == g for h, _ in rows) + 1))


# --- line items ------------------------------------------------------------------

LINE = ("document_id int, line_index long, item_name string, document_item_code string, item_code string, specification string, quantity string, unit_price string, "
        "supply_amount string, tax_amount string, line_total string, validation_warnings array<string>, review_flags array<string>")


def lines(spark, *rows):
    return spark.createDataFrame([(1, i, n, None, c, s, q, p, a, t, v, list(w), list(f)) for i, n, c, s, q, p, a, t, v, w, f in rows], LINE)


def test_dedupe_compares_numbers_by_value(spark):
    df = lines(spark, (1, "볼트", "A", "M8", "1,000", "5", "5000", "500", "5500", (), ()), (2, "볼 트", "a", "M8", "1000.0", "5", "5,000", "500", "5500", (), ()),
               (3, "볼트", "A", "M8", "1000", "6", "5000", "500", "5500", (), ()))
    assert sorted(r["line_index"] for r in L.dedupe_lines(df).collect()) == [1, 3]


def test_dedupe_parsed_keeps_sparse_repeats_in_long_documents(spark):
    sparse = [(i, "bolt", None, None, None, None, None, None, None, (), ()) for i in range(1, 9)]
    assert L.dedupe_parsed_lines(lines(spark, *sparse)).count() == 8
    assert L.dedupe_parsed_lines(lines(spark, *sparse[:7])).count() == 1


def test_line_warnings_and_adjustments(spark):
    df = lines(spark, (1, "a", "c", "s", "1", "1", "100", "200", "150", (), ()), (2, "a", "c", "s", "1", "1", "-100", "-10", "-110", (), ()))
    got = {r["line_index"]: r["amount_warnings"] for r in L.line_warnings(df).collect()}
    assert got == {1: ["invalid_tax_greater_than_total", "invalid_tax_greater_than_supply", "invalid_line_total"], 2: []}


def test_unparsable_total_counts_as_mismatch(spark):
    docs = spark.createDataFrame([(1, Decimal("100.00"), "KRW")], "document_id int, extracted_amount decimal(18,2), currency string")
    df = lines(spark, (1, "a", "c", "s", "1", "1", "1", "1", "백", (), ()))
    assert L.total_mismatch(docs, df, "quality").first()["mismatch"] is True


# --- merging ---------------------------------------------------------------------

@pytest.mark.parametrize("documents,size,names", [(12, 5, ["bolt", "bolt m8", "nut", "nut m8", "pin"]), (2, 120, ["bolt", "bolt m8", "lt", "nut", "n", None, "pin", "pinion", "m8", *(f"part{i}" for i in range(40))])])
def test_pair_items_is_the_greedy_pairing(spark, documents, size, names):
    rng = random.Random(3)
    schema = "document_id int, line_index long, item_name string, item_code string, specification string, unit string"
    make = lambda: [(d, i, rng.choice(names), rng.choice([None, None, "A1", "B2"]), None, "EA") for d in range(documents) for i in range(size)]
    p_rows, s_rows = make(), make()
    got = {(r["document_id"], r["line_index"], r["secondary_index"]) for r in G.pair_items(spark.createDataFrame(p_rows, schema), spark.createDataFrame(s_rows, schema)).collect()}
    squeeze = lambda v: "".join(ch for ch in (v or "").lower() if ch not in " _/-")
    key = lambda r: squeeze(r[3]) if r[3] else "|".join([x for x in (squeeze(r[2]), squeeze(r[4]), squeeze(r[5])) if x])
    want = set()
    for d in range(documents):
        used = set()
        sec = [r for r in s_rows if r[0] == d]
        for p in (r for r in p_rows if r[0] == d):
            hit = next((s for s in sec if s[1] not in used and key(s) == key(p)), None)
            hit = hit or next((s for s in sec if p[2] and s[2] and s[1] not in used and (squeeze(p[2]) in squeeze(s[2]) or squeeze(s[2]) in squeeze(p[2]))), None)
            if hit:
                used.add(hit[1])
                want.add((d, p[1], hit[1]))
    assert got == want


# --- layout ----------------------------------------------------------------------

TOKEN = "doc_id string, page int, text string, confidence double, x_min double, y_min double, x_max double, y_max double"


def test_rows_by_gap_and_by_running_mean(spark):
    tok = lambda page, text, x, y: ("d", page, text, 0.9, x, y, x + 10.0, y + 12.0)
    t = spark.createDataFrame([tok(1, "a", 0.0, 100.0), tok(1, "b", 50.0, 104.0), tok(1, "c", 0.0, 130.0), tok(2, "d", 0.0, 100.0)], TOKEN)
    want = {"a": 1, "b": 1, "c": 2, "d": 1}
    for df in (Y.group_rows_by_y(t), Y.group_rows_exact(t), Y.group_rows_exact(t, fixed=8.0)):
        assert {r["text"]: r["row_index"] for r in df.collect()} == want


def test_running_mean_differs_from_gaps_on_a_slope(spark):
    t = spark.createDataFrame([("d", 1, str(i), 0.9, i * 20.0, 100.0 + 7 * i, i * 20.0 + 10, 112.0 + 7 * i) for i in range(4)], TOKEN)
    assert {r["row_index"] for r in Y.group_rows_by_y(t).collect()} == {1}
    assert {r["text"]: r["row_index"] for r in Y.group_rows_exact(t, fixed=8.0).collect()} == {"0": 1, "1": 1, "2": 2, "3": 2}


def brute_rows(ys, heights, fixed):
    """The rule as it is stated: all rows in order of age, the median of all heights so far."""
    rows, seen, labels = [], [], []
    for y, h in zip(ys, heights, strict=True):
        tolerance = fixed if fixed is not None else max(8.0, min(30.0, 0.75 * (statistics.median(seen) if seen else h)))
        row = next((r for r in rows if abs(sum(r) / len(r) - y) <= tolerance), None)
        if row is None:
            rows.append(row := [])
        row.append(y)
        labels.append(row)
        seen.append(h)
    order = sorted(range(len(rows)), key=lambda i: sum(rows[i]) / len(rows[i]))
    return [next(n for n, i in enumerate(order, 1) if rows[i] is r) for r in labels]


@pytest.mark.parametrize("fixed", [None, 8.0, 3.0])
def test_running_rows_equal_the_rule(fixed):
    rng = random.Random(5)
    for n in (1, 2, 40, 300):
        for spread in (20, 400, 3000):
            ys = sorted(round(rng.uniform(0, spread), 1) for _ in range(n))
            heights = [rng.choice([1.0, 9.0, 12.0, 30.0, 60.0]) for _ in ys]
            assert Y._page_rows(ys, heights, fixed) == brute_rows(ys, heights, fixed)


def test_rows_of_a_crowded_page_take_seconds():
    start = time.perf_counter()
    assert max(Y._page_rows([i * 0.5 for i in range(100_000)], [12.0] * 100_000, None)) > 1000
    assert time.perf_counter() - start < 10


def test_columns_are_the_clusters_of_sorted_centres(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for d in range(30):
        xs = sorted(round(rng.uniform(-200, 2500), 1) for _ in range(rng.randrange(1, 40)))
        xs += [xs[-1] + 55, xs[-1] + 110.25]  # exactly the gap, and above it
        clusters = []
        for x in xs:
            if clusters and x - clusters[-1][-1] <= 55:
                clusters[-1].append(x)
            else:
                clusters.append([x])
        want |= {(f"d{d}", f"unknown_{i}", round(min(c) - 28, 6), round(max(c) + 28, 6), round(sum(c) / len(c), 6), round(min(0.75, 0.35 + len(c) / 20), 6)) for i, c in enumerate(clusters, 1) if len(c) > 1}
        rows += [(f"d{d}", 1, "t", 0.9, x - 5, 0.0, x + 5, 10.0) for x in xs]
    rng.shuffle(rows)
    found = Y.infer_columns(spark.createDataFrame(rows, TOKEN).repartition(4))
    assert {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found.select("doc_id", "name", "x_min", "x_max", "x_center", "confidence").collect()} == want
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


# --- text ------------------------------------------------------------------------

SLIP = "발주서\n발주번호: PO-2024-0001\n발행일: 2024.03.05  납기일: 2024-04-01\n품목명, 규격, 수량, 단가\n볼트, M8, 10, 5\n너트, M8, 20, 3\n합계\n1,100원\n"


def test_slip(spark):
    assert one(spark, SLIP, X.classify_type("t"), X.document_number("t")) == ("purchase_order", "PO-2024-0001")
    assert one(spark, SLIP, X.labelled_amount("t", ["합계"])) == Decimal("1100.0000")  # value on the next line
    dates = one(spark, SLIP, X.typed_dates("t", F.lit("purchase_order")))
    assert (dates["issue_date"], dates["due_date"]) == (dt.date(2024, 3, 5), dt.date(2024, 4, 1))
    df = spark.createDataFrame([("d", SLIP)], "doc string, text string")
    assert [(r["item_name"], r["quantity"]) for r in X.table_items(df, "doc").orderBy("row").collect()] == [("볼트", "10"), ("너트", "20")]
    kv = {(r["key"], r["value"]) for r in X.key_values(df, "doc").collect()}
    assert {("발행일", "2024.03.05"), ("납기일", "2024-04-01"), ("발주번호", "PO-2024-0001")} <= kv


def test_compact_text_keeps_whole_lines_within_budget(spark):
    text = "\n".join(f"line {i} " + "x" * (i % 7) for i in range(300))
    out = one(spark, text, X.compact_text("t", 500))
    assert len(out) <= 500 and set(out.split("\n")) <= {v.strip() for v in text.split("\n")}
    assert one(spark, "short\ntext", X.compact_text("t", 500)) == "short\ntext"


def test_classifiers_on_special_documents(spark):
    assert one(spark, "TRF-2024-01 자재 이동", X.taxonomy("t", F.lit("general_document")))["subtype"] == "internal_transfer"
    assert one(spark, "credit memo 12", X.classify_type("t"), X.classify_category("t")) == ("general_document", "credit_note")
    assert one(spark, "커피 cafe latte 2", X.spend_context("t"))["subtype"] == "meal_or_cafe"


# --- sources -----------------------------------------------------------------------

def test_item_master_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("﻿internal_item_code, item_name ,spec,standard_price,active,aliases,material\nA1,볼트,M8,\"1,000원\",사용,b1|b2;,steel\n,너트,,,,,\nA2,와샤,,x,n,,\n", encoding="utf-8")
    rows, errors = RD.read_item_master(spark, str(path))
    got = {r["internal_item_code"]: (r["normalized_item_name"], r["standard_price"], r["active"], r["aliases"]) for r in rows.collect()}
    assert got == {"A1": ("볼트", Decimal("1000.00"), True, ["b1", "b2"]), "A2": ("와셔", None, False, [])}
    assert [(r["row_number"], r["error"]) for r in errors.collect()] == [(3, "3행: internal_item_code와 item_name은 필수입니다.")]


def test_item_master_missing_column(spark, tmp_path):
    (tmp_path / "m.csv").write_text("item_name\nx\n")
    rows, errors = RD.read_item_master(spark, str(tmp_path / "m.csv"))
    assert rows.count() == 0 and errors.first()["error"] == "필수 컬럼이 없습니다: internal_item_code"


def test_text_corpus(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_no": "X1", "rows": [{"n": 1}, {"n": 2}]}')
    (tmp_path / "b.csv").write_text('a,"b, c",\n,,\n')
    (tmp_path / "c.html").write_text("<p>One</p><script>x</script><p> Two </p>")
    (tmp_path / "d.txt").write_bytes("caf\xe9  x\n\n y".encode("latin-1"))
    (tmp_path / "e.bin").write_bytes(b"%PDF-1.4")
    got = {r["path"].rsplit("/", 1)[1]: r["normalized_text"] for r in RD.read_text_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.json": "doc no: X1\nrows[0].n: 1\nrows[1].n: 2", "b.csv": "a | b, c", "c.html": "One\nTwo", "d.txt": "café x\ny"}


# --- exports and upserts --------------------------------------------------------------

def test_export_gate(spark):
    docs = spark.createDataFrame([(1, "t", "f", "confirmed"), (2, None, "f2", "ready")], "document_id int, title string, original_filename string, processing_status string")
    with pytest.raises(E.ExportBlocked) as exc:
        E.assert_exportable(docs)
    assert exc.value.blocked_count == 1 and exc.value.blocked_documents[0]["title"] == "f2"
    assert E.assert_exportable(docs.filter("document_id = 1")).count() == 1


def test_write_by_party(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), (None, 2), ("A", 3)], "party_tab string, n int")
    E.write_by_party(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert {(r["party_tab"], r["n"]) for r in back.collect()} == {("A", "1"), ("미분류", "2"), ("A", "3")}


def test_template_defaults():
    made = E.normalize_template([{"header": "", "source_field": "__static__", "static_value": None}, {"source_field": "x", "column_type": "odd"}])
    assert [(c["header"], c["column_type"], c["static_value"]) for c in made] == [("컬럼 1", "static", ""), ("컬럼 2", "field", "")]


def test_upsert_replace(spark):
    cols = "internal_item_code string, item_name string, spec string, unit string, category string, standard_price decimal(18,2), active boolean, aliases array<string>"
    cur = spark.createDataFrame([("A", "a", None, None, None, None, True, [])], cols)
    new = spark.createDataFrame([("B", "b1", None, None, None, None, True, [], 2), ("B", "b2", None, None, None, None, True, [], 3)], cols + ", row_number long")
    out, counts = U.upsert_master(cur, new, "replace")
    assert [r["item_name"] for r in out.collect()] == ["b2"] and counts.first()["inserted"] == 1
    out, counts = U.upsert_master(cur, new)
    assert sorted(r["item_name"] for r in out.collect()) == ["a", "b2"]


def test_report_prefers_mapping_lines_and_zero_falls_through(spark):
    ln = spark.createDataFrame([(1, Decimal("0.00"), Decimal("7.00"))], "document_id int, supply_amount decimal(18,2), line_total decimal(18,2)")
    assert ln.select(R.line_amount(ln)).first()[0] == Decimal("7.00")


# --- matching ---------------------------------------------------------------------------

MASTER = "item_id long, internal_item_code string, item_name string, spec string, unit string, standard_price decimal(18,2), active boolean, aliases array<string>"


def test_match_statuses(spark):
    master = spark.createDataFrame([
        (1, "BLT-0001-A", "육각볼트", "M8x20", "EA", Decimal("100.00"), True, ["hex bolt"]), (2, "PLT-304-2T", "SUS304 plate", "2t", "EA", Decimal("900.00"), True, []),
        (3, "PLT-316-2T", "SUS316 plate", "2t", "EA", Decimal("950.00"), True, []), (4, "OLD-1", "낡은 것", None, "EA", None, False, [])], MASTER)
    alias = spark.createDataFrame([], "item_id long, alias_name string, alias_spec string, active boolean")
    probe = spark.createDataFrame([
        (1, "blt-0001-a", "아무거나", None, "EA", None), (2, None, "hex bolt", None, "EA", None), (3, "HEX BOLT", "x", None, "EA", None), (4, None, "스테인리스 판재", "2t", "EA", None), (5, None, "qwerty", None, None, None)],
        "document_id int, item_code string, item_name string, specification string, unit string, unit_price decimal(18,2)")
    got = {r["document_id"]: (r["status"], r["matched_code"]) for r in M.match_lines(probe, master, alias).collect()}
    assert got[1] == ("direct_code_match", "BLT-0001-A") and got[2] == ("alias_matched", "BLT-0001-A") and got[3] == ("alias_matched", "BLT-0001-A")
    assert got[4][1] is None and got[5] == ("unmatched", None)


# --- streams -------------------------------------------------------------------------------

def test_late_events_are_dropped(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    rows = lambda *ts: spark.createDataFrame([(i, dt.datetime.fromisoformat(t), "view") for i, t in enumerate(ts)], "event_id long, ts timestamp, event_type string")

    def run():
        stream = J.read_stream(spark, str(src), rows().schema)
        J.stage_counts(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for batch in (["2024-01-01T01:00:00", "2024-01-01T02:00:00"], ["2024-01-05T00:00:00"], ["2024-01-01T03:00:00", "2024-01-09T00:00:00"]):
        rows(*batch).coalesce(1).write.mode("append").parquet(str(src))
        run()
    got = {r["bucket_start"].date().isoformat(): r["n"] for r in spark.read.parquet(str(out)).collect()}
    assert got == {"2024-01-01": 2, "2024-01-05": 1}  # the late row of Jan 1 is gone, Jan 9 is still open


def test_latest_survives_several_batches(spark, tmp_path):
    src = tmp_path / "in"
    mk = lambda *r: spark.createDataFrame([(u, dt.datetime(2024, 1, d), e) for u, d, e in r], "user_id long, ts timestamp, event_id long")
    for batch in ([(1, 1, 10), (2, 1, 11)], [(1, 3, 12)], [(1, 2, 13), (3, 1, 14)]):
        mk(*batch).coalesce(1).write.mode("append").parquet(str(src))
        J.stream_latest(J.read_stream(spark, str(src), mk().schema), ["user_id"], str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {(r["user_id"], r["event_id"]) for r in J.read_latest(spark, str(tmp_path / "t"), ["user_id"]).collect()} == {(1, 12), (2, 11), (3, 14)}
    J.compact_latest(spark, str(tmp_path / "t"), str(tmp_path / "u"), ["user_id"])
    assert J.read_latest(spark, str(tmp_path / "u"), ["user_id"]).count() == 3


def test_window_ratio_skips_no_better_window():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14))) for _ in range(2))
        short, whole = sorted((a, b), key=len)
        every = [whole] + [whole[i:i + w] for w in (len(short) - 1, len(short), len(short) + 1) for i in range(len(whole) - w + 1) if len(short) >= 3]
        assert S.window_ratio(a, b) == max(SequenceMatcher(None, short, x).ratio() for x in every)


def brute_match(probes, master, aliases):
    """Every pair scored by the rules, best first."""
    out = {}
    for q in probes:
        scored = []
        for m in master:
            own = [(m["name"], None, False), *((n, sp, True) for i, n, sp in aliases if i == m["item_id"])]
            best = alias = 0.0
            for n, sp, is_alias in own:
                value = S.name_similarity(q["name"], n)
                if is_alias and sp:
                    value = value * 0.82 + brute_spec(q["spec"], sp) * 0.18
                best, alias = max(best, value), max(alias, value if is_alias else 0.0)
            unit = 0.5 if not q["unit"] or not m["unit"] else float(q["unit"] == m["unit"])
            price = 0.5
            if q["price"] is not None and m["price"]:
                off = round(abs(q["price"] - m["price"]), 6) / m["price"]
                price = 1.0 if off <= 0.02 else 0.7 if off <= 0.10 else 0.0
            raw = best * 0.55 + brute_spec(q["spec"], m["spec"]) * 0.20 + unit * 0.15 + price * 0.10
            scored.append((-rank_join.rounded(raw), m["item_id"], alias >= 0.96))
        out[q["id"]] = sorted(scored)
    return out


def brute_spec(s, t):
    return 0.5 if not s or not t else 1.0 if s == t else 0.75 if s in t or t in s else S.ratio(s, t) * 0.80


@pytest.mark.parametrize("block_names", [20_000, 25])
def test_fuzzy_match_keeps_the_best_of_all_pairs(spark, block_names):
    rng = random.Random(11)
    parts = ["볼트", "와셔", "너트", "hex", "bolt", "m8", "sus304", "plate", "철판", "bearing", "6204", "a", "zinc", "플랜지", "스프링"]
    make = lambda k=5: "".join(rng.choice(parts) for _ in range(rng.randrange(1, k)))

    def noisy(t):
        chars = list(t)
        for _ in range(rng.randrange(4)):
            chars[rng.randrange(len(chars))] = rng.choice("xol1볼불")
        return "".join(chars)

    specs, units = ["", "m8x20", "m8x25", "m10", "304", "t12"], ["ea", "", "kg"]
    master = [{"item_id": i, "name": make(), "spec": rng.choice(specs), "unit": rng.choice(units), "price": rng.choice([None, 0.0, 10.0, 10.15, 12.5, 99.99])} for i in range(90)]
    master += [{"item_id": 90 + i, "name": n, "spec": "", "unit": "ea", "price": 10.0} for i, n in enumerate(["abcdefghij", "aXcdYfgZij", "ab", "가", "hexboltm8", "hexboltm8", "hexboltm8"])]
    aliases = [(rng.randrange(90), make(3), rng.choice([None, "", "m8x20", "m10"])) for _ in range(40)] + [(i, "samealias", None) for i in (3, 4, 5, 90)]
    probes = [{"id": str(i), "name": noisy(rng.choice(master)["name"]), "spec": rng.choice(specs), "unit": rng.choice(units), "price": rng.choice([None, 10.0, 9.9, 12.0])} for i in range(60)]
    probes += [{"id": n, "name": n, "spec": "", "unit": "ea", "price": 10.0} for n in ("aXcdYfgZij", "abcXefgYij", "b", "samealias", "unlikeany", "galvanisedzincplatedhexboltm8grade88")] + [{"id": "none", "name": "", "spec": "m10", "unit": "kg", "price": 12.5}]
    p = spark.createDataFrame([(q["id"], None, q["name"], q["spec"] or None, q["unit"] or None, q["price"]) for q in probes], "probe_id string, item_code string, item_name string, specification string, unit string, unit_price double")
    m = spark.createDataFrame([(x["item_id"], f"C{x['item_id']}", x["name"], x["spec"], x["unit"], x["price"], True) for x in master] + [(500, "C500", "hexboltm8", "m8x20", "ea", 10.0, False)], "item_id long, internal_item_code string, item_name string, spec string, unit string, standard_price double, active boolean")
    al = spark.createDataFrame(aliases, "item_id long, name string, spec string")
    found = M.match_fuzzy(p, m, al, keep=6, block_names=block_names).collect()
    texts = spark.createDataFrame([(t,) for t in {x["name"] for x in [*probes, *master]} | {x["spec"] for x in [*probes, *master]} | {x for _, n, t in aliases for x in (n, t or "")}], "t string")
    normal = {r["t"]: (r["n"] or "", r["s"] or "") for r in texts.select("t", T.normalize_item_text("t").alias("n"), T.normalize_spec("t").alias("s")).collect()}
    plain = lambda rows: [{**x, "name": normal[x["name"]][0], "spec": normal[x["spec"]][1]} for x in rows]
    want = brute_match(plain(probes), plain(master), [(i, normal[n][0], normal[t or ""][1]) for i, n, t in aliases])
    got = {}
    for r in found:
        got.setdefault(r["probe_id"], []).append((-r["score"], r["item_id"], r["alias_name"]))
    for q in probes:
        best = [x for x in want[q["id"]][:6] if -x[0] >= 0.35]
        assert sorted(got.get(q["id"], []))[: len(best)] == best, q
        assert min(sum(x[2] for x in got.get(q["id"], [])), 2) == min(sum(x[2] for x in want[q["id"]] if -x[0] >= 0.35), 2), q


def test_prefix_hits_keep_their_floor(spark):
    p = spark.createDataFrame([("1", "abcdefgh", "bolt", None, "ea", 1.0)], "probe_id string, item_code string, item_name string, specification string, unit string, unit_price double")
    m = spark.createDataFrame([(i, f"abcdefgh{i}", n, None, "ea", 1.0, True) for i, n in enumerate(["bolt", "wholly different", "nut"])], "item_id long, internal_item_code string, item_name string, spec string, unit string, standard_price double, active boolean")
    none = spark.createDataFrame([], "item_id long, name string, spec string")
    got = {r["item_id"]: (r["score"], r["prefix"]) for r in M.match_fuzzy(p, m, none, M.match_prefix_code(p, m), keep=1).collect()}
    assert got[0] == (0.9, True) and got[1][0] >= 0.7 and got[2][0] >= 0.7 and all(x[1] for x in got.values())


def test_mapping_lines_replace_the_documents_own(spark):
    docs = spark.createDataFrame([(1, True), (2, False), (3, True)], "document_id long, ok boolean")
    own = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "document_id long, item_name string")
    mapped = spark.createDataFrame([(1, "m"), (2, "n")], "document_id long, item_name string")
    got = sorted(map(tuple, R.effective_lines(docs, own, mapped, F.col("ok")).collect()))
    assert got == [(1, "m"), (2, "c"), (3, "d")]


def test_structured_texts_keep_everything(spark):
    deep = '{"z": "[draft] x", "a": [0, {"k_1": "{curly}"}, [[["deep"]]]], "b": null, "t": true}'
    rows = X.flatten_json(spark.createDataFrame([(1, deep), (2, "{broken"), (3, None)], "id long, j string"), "id", "j").orderBy("id", "pos").collect()
    assert [r["line"] for r in rows] == ["z: [draft] x", "a[0]: 0", "a[1].k 1: {curly}", "a[2][0][0][0]: deep", "b: None", "t: True"]
    assert one(spark, 'a;"q ""z"" ; x";c\n;;\n1;2;3', X.csv_lines("t")) == 'a | q "z" ; x | c\n1 | 2 | 3'
    assert one(spark, "<p>A &amp; B<!-- x > y --></p>", X.html_text("t")) == "A & B"
    assert one(spark, "<a><b>1 &lt; 2</b>", X.xml_lines("t")) == "<a><b>1 &lt; 2</b>"
    with pytest.raises(ValueError):
        X.key_values(spark.createDataFrame([(1, "a: b")], "key long, text string"), "key")


@pytest.mark.parametrize("text, category", [
    ("po no 17 납기일", "purchase_order"), ("유효기간 30 견적금액", "quotation"), ("공급가액 세액", "transaction_statement"), ("plain words", None),
    ("Implementation schedule roadmap: testing coverage", "implementation_schedule"), ("install, configure and run docker", "installation_guide"), ("Name: Ann\nAge: 7", "profile_record"),
])
def test_categories_by_words_and_signals(spark, text, category):
    assert one(spark, text, X.classify_category("t")) == category


def test_important_lines_looks_at_every_line(spark):
    text = "\n".join([f"plain words {chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Deadline: 2024-05-01"])
    assert "Deadline: 2024-05-01" in one(spark, text, X.important_lines("t"))
    assert "Deadline: 2024-05-01" not in one(spark, text, X.important_lines("t", most_lines=40))


def test_key_values_of_any_length(spark):
    long, key = "x" * 300, "a label of more than forty characters in all"
    text = f"비고: {long}\nnote: {long}\n상호 {long}\n{key}: v\n상호 {long} 10:30"
    df = spark.createDataFrame([(1, text)], "doc long, text string")
    want = [("비고", long), ("note", long), ("상호", long), (key, "v"), ("상호", f"{long} 10:30")]
    assert [(r.key, r.value) for r in X.key_values(df, "doc").orderBy("pos").collect()] == want
    assert [(r.key, r.value) for r in X.carry_sections(df, "doc").orderBy("pos").collect()] == want
    assert [r.key for r in X.key_values(df, "doc", longest_key=40, longest_value=100).collect()] == []
    assert [r.key for r in X.carry_sections(df, "doc", longest_value=100).collect()] == [key]
