import pytest

from loamline.operators import session_groups as S


def test_views_follow_the_session(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    chunks = spark.createDataFrame([(1, ["hr"]), (2, ["staff", "hr"]), (3, []), (4, None)], "id int, readers array<string>")
    S.install(spark, {"open_view": (c, None), "pay_view": (c, ["hr", "o'exec"])}, {"chunk_view": (chunks, "readers")})
    seen = lambda: tuple(spark.table(v).count() for v in ("open_view", "pay_view", "chunk_view"))
    n = c.count()
    assert S.current_groups(spark) == [] and seen() == (0, 0, 0)
    with S.groups_of(spark, ["staff"]):
        assert S.current_groups(spark) == ["staff"] and seen() == (n, 0, 1)
    with S.groups_of(spark, ["o'exec", "hr"]):
        assert seen() == (n, n, 2)
    with S.groups_of(spark, []):
        assert seen() == (0, 0, 0)
    with pytest.raises(ValueError), S.groups_of(spark, ["hr"]):
        raise ValueError
    assert S.current_groups(spark) == [] and seen() == (0, 0, 0)
    with S.groups_of(spark, ["staff"]):  # a statement of any shape reads the filtered rows
        assert spark.sql("select count(*) from open_view o where exists (select 1 from chunk_view) and not exists (select 1 from pay_view)").first()[0] == n
