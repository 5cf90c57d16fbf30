"""Findings of round 4, each against what the code did before."""

from lexispark.llm import spelling

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_hot_roots_are_broadcast(spark, monkeypatch):
    """F1, op11: Spark took keys, ten times as many as words, for as few, and sent them all through the driver."""
    plans, write, settle = [], spelling.materialize, spelling.settled

    def seen(df, name):
        plans.append((name, planned(df)))
        return write(df, name)

    def whole(df, session, name):
        def noted():
            out = df()
            plans.append((name, planned(out)))
            return out

        return settle(noted, session, name)

    monkeypatch.setattr(spelling, "materialize", seen)
    monkeypatch.setattr(spelling, "settled", whole)
    assert spelling.spelling_variants(spark.read.parquet(f"{SF}/documents.parquet")).count()
    assert {name for name, _ in plans} == {"counted", "words", "near", "known", "pointers", "onward", "last", "variants"}
    for name, plan in plans:
        sent = plan.count("BroadcastExchange")
        # a doubling of pointers, and the roots at the end, send their hot keys twice: rows to join, and marks
        assert sent == (2 if name in ("pointers", "variants") and "SortMergeJoin" in plan else 0), (name, plan)
    assert sum("BroadcastExchange" in plan for _, plan in plans) >= 2
