"""Fields of a text read inside its row equal those of the exploded pairs; a stream's state is asked once per alias of a frame."""

from __future__ import annotations

import pandas as pd

from bizdocs.operators import text_tables as X
from bizdocs.streaming.learning import Learner

TEXTS = [
    "문서번호: PO-1\n공급업체: 나라 상사\n고객사: (주)가나\n공급가액 100\n세액 10", "공급자: 담당\n공급자 상호: (주)다라\n합계: 0\n합계: 5", "no pair at all", None,
    "납기일: 2024-01-02\n공급가액: 100.00\n세액: 10.00\n합계: 100.00", "고객사: a\n고객사: b 1\nbuyer: c",
]


def test_fields_equal_those_of_pairs(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    own = X.text_semantic_fields(df)
    pairs = X.semantic_fields(X.key_values(df, "id"), "id")
    names = ["id", *X.FIELD_ALIASES]
    assert sorted(own.select(names).collect(), key=str) == sorted(pairs.select(names).collect(), key=str)
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()


class State:
    def __init__(self):
        self.rows, self.asked = {}, 0

    def exists(self):
        return False

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.asked += 1
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value


def test_state_is_asked_once_per_alias():
    learner = Learner()
    learner.entry, learner.alias = State(), State()
    rows = [{"entry_id": "e", "normalized_value": "n", "field": "f" if i % 2 else None, "told_at": 100 - i, "alias_value": f"a{i % 3}", "normalized_alias_value": f"a{i % 3}"} for i in range(90)]
    out = pd.concat(learner.handleInputRows(("item", "v"), iter([pd.DataFrame(rows)]), None))
    assert learner.alias.asked == 3
    assert sorted(out["alias_value"].dropna()) == ["a0", "a1", "a2"]
    assert learner.entry.value == ("e", "n", "f", 11, "accepted_suggestion", True, 1)
