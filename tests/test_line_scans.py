"""Sections and item blocks against a line-by-line reading."""

import random
import re
import time

from bizdocs.operators import text_tables as X

LABELS = {"품목명": "item_name", "품목코드": "item_code", "수량": "quantity", "단위": "unit"}


def lines_of(text):
    return [v for v in (re.sub(r"\s+", " ", line).strip() for line in text.split("\n")) if v]


def blocks(text):
    out, cur, seen, last = [], {}, False, None
    for v in lines_of(text):
        m = re.match(r"^\s*([^:：|]+?)\s*[:：]\s*(.*?)\s*$", v)
        field = LABELS.get(m.group(1)) if m else None
        if field == "item_name" and seen and (cur.get("item_name") or cur.get("item_code")):
            out.append(cur)
            cur = {}
        if field:
            cur[field], seen, last = m.group(2) or None, True, field
        elif not m and last == "item_name" and cur.get("item_name") and "총 합계" not in v:
            cur["item_name"] += " " + v
    return out + [cur] if cur.get("item_name") or cur.get("item_code") else out


def sections(text):
    out, section = [], None
    for v in lines_of(text):
        m = re.match(r"^(공급받는자|공급자)(?:\s|$|:)", v)
        section = m.group(1) if m else section
        if ": " in v:
            k, value = v.split(": ", 1)
            out.append((f"{section} {k}" if section and k in X.SECTION_KEYS else k, value))
    return out


def test_blocks(spark):
    rng = random.Random(11)
    pool = ["품목명: 볼트", "품목명: 너트", "품목명:", "품목코드: A1", "품목코드:", "수량: 3", "수량:", "단위: EA", "메모: x", "이어짐", "끝 줄", "총 합계", "  "]
    texts = [(i, "\n".join(rng.choices(pool, k=rng.randrange(14)))) for i in range(500)] + [(500, ""), (501, None)]
    got = {}
    for r in X.segment_items(spark.createDataFrame(texts, "doc long, text string"), "doc").orderBy("doc", "item_no").collect():
        got.setdefault(r.doc, []).append((r.item_name, r.item_code, r.quantity, r.unit))
    for doc, text in texts:
        want = [tuple(b.get(f) for f in ("item_name", "item_code", "quantity", "unit")) for b in blocks(text or "")]
        assert got.get(doc, []) == want, text


def test_sections(spark):
    rng = random.Random(12)
    pool = ["공급자", "공급받는자", "공급자x", "상호: 가나", "담당: 다라", "비고: 마", "그냥", ""]
    texts = [(i, "\n".join(rng.choices(pool, k=rng.randrange(12)))) for i in range(300)] + [(300, None)]
    got = {}
    for r in X.carry_sections(spark.createDataFrame(texts, "doc long, text string"), "doc").orderBy("doc", "pos").collect():
        got.setdefault(r.doc, []).append((r.key, r.value))
    for doc, text in texts:
        assert got.get(doc, []) == sections(text or ""), text


def test_long_text_in_linear_time(spark):
    """Ten times the lines must not take much more than ten times as long; the old folds took a hundred."""
    def seconds(n):
        text = "\n".join(f"품목명: n{i}\n수량: {i}\n공급자\n상호: s{i}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc long, text string")
        start = time.time()
        assert X.segment_items(df, "doc").count() == n
        assert X.carry_sections(df, "doc").filter("section = '공급자'").count() == n
        return time.time() - start

    seconds(100)
    small, large = seconds(2500), seconds(25000)
    assert large < 30 * max(small, 0.5), (small, large)
