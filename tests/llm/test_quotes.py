"""Quotation links against a plain Python reading of the same rules."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quotes


def parts(text):
    out = []
    for line in (text or "").split("\n"):
        sign = re.match(quotes.MARK, line)
        level, body = (sign[0].count(">"), line[sign.end() :]) if sign else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
    return [(level, "\n".join(b)) for level, b in out]


def own(p):
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"^\s+|\s+$", "", "\n".join(b for level, b in p if level == 0)))


def names(bodies):
    found = {re.sub(r"\s+", " ", piece.lower()).strip(" ") for b in bodies for piece in (b, *re.split(r"\n[ \t]*\n", b))}
    return found - {""}


def brute(rows):
    first, out, parent = {}, {}, {}
    for c, t, _, text in rows:
        if c is not None and t is not None:
            p = parts(text)
            for n in names([b for level, b in p if level == 0] + [own(p)]):
                first[c, n] = min(t, first.get((c, n), t))
    for c, t, _, text in rows:
        for level, body in parts(text):
            for n in names([body]) if level and c is not None and t is not None else ():
                q = first.get((c, n))
                if q is not None and q < t:
                    by = out.setdefault((c, t), {})
                    by[level] = max(q, by.get(level, q))
    for key, by in out.items():
        parent[key] = by[min(by)]
    result = []
    for c, t, role, text in rows:
        chain, depth = t, 0
        while (c, chain) in parent:
            chain, depth = parent[c, chain], depth + 1
        quoted = any(level for level, _ in parts(text))
        body = own(parts(text)) if quoted else text or ""
        result.append((c, t, role, parent.get((c, t)), chain, depth, len(out.get((c, t), {})), f"<|{role or 'unknown'}|>\n{body}<|end|>\n"))
    return result


CASES = {
    "thread": [
        (1, 0, "user", "Hello there.\n\nHow are you?"), (1, 1, "bot", "> How are  YOU?\nFine."), (1, 2, "user", "> > how are you?\n> fine.\n\nGood!"), (1, 3, "bot", ">>> How are you?\n>> Fine.\n> Good!\nBye"),
        (1, 4, "user", "plain"), (1, 5, "bot", "> never said\nwhat?"), (2, 1, "bot", "> Hello there.\nother conversation"), (1, 6, "user", "a > b is no quote"),
    ],
    "chain": [(7, i, "r", f"> line {i - 1}\nline {i}" if i else "line 0") for i in range(40)],
    "odd": [
        (None, 1, "u", "> x"), (3, None, "u", "x"), (3, 1, None, None), (3, 2, "u", ""), (3, 3, "u", "> \n>\n"), (3, 4, "u", "same"), (3, 4, "u", "same"), (3, 5, "u", "> same"), (3, 5, "u", "> same"), (3, 6, "u", "> same\n\n> \n"),
        (3, 7, "u", "\t> same\n   >   same \nx\n\n\n\ny"), (3, 8, "u", "> later"), (3, 9, "u", "later"),
    ],
    "hot": [(9, i, "u", "common" if i % 3 else "> common\nme too") for i in range(300)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_plain_reading(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = quotes.conversations(df).select("conv_id", "turn", "role", "reply_to", "thread", "depth", "quoted", "formatted").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_long_text_empty_table_and_clashing_names(spark):
    long = "\n".join(f"{'>' * (i % 3)} line {i}" for i in range(6000))
    df = spark.createDataFrame([(1, 1, "u", long, "x"), (1, 0, "u", "line 7\n\nz", None)], "conv_id long, turn long, role string, text string, thread string")
    rows = {r.turn: r for r in quotes.conversations(df).collect()}
    assert rows[1].thread_ == 0 and rows[1].thread == "x" and rows[1].reply_to == 0
    assert quotes.conversations(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 1, "u", "> x")], "conv_id long, turn long, role string, text string")
    plan = quotes.conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
    assert quotes.links(df).where(F.lit(True)).count() == 0


@pytest.mark.parametrize("name", CASES)
def test_sql_reads_the_same(name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    frame = pd.DataFrame(CASES[name], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "role": object, "text": object})
    con.register("given", frame)
    con.execute("CREATE VIEW conversations AS SELECT conv_id, turn, CAST(role AS VARCHAR) AS role, CAST(text AS VARCHAR) AS text FROM given")
    assert sorted(map(str, con.execute(quotes.ORACLE).fetchall())) == sorted(map(str, brute(CASES[name])))
