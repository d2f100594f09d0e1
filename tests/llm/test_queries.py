from kmerloom.llm import queries


def test_one_query_for_each_operator():
    names = sorted(queries.queries(), key=lambda x: int(x[2:].split("_")[0]))
    assert [int(x[2:].split("_")[0]) for x in names] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
