import textwrap

import duckdb

from termfield.llm import license as li
from termfield.llm.queries import ORACLE_SQL, op9_license


def dice(a, b):
    x, y = li.bigram_counts(a), li.bigram_counts(b)
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, license, dice, n_lines FROM ({ORACLE_SQL['op9_license']})").fetchall())
    got = sorted(map(tuple, op9_license(spark, "/root/testdata/sf0.01").select("doc_id", "license", "dice", "n_lines").collect()))
    assert got == want and len(got) > 10


def test_published_layout_inside_a_long_document(spark):
    """Licences with blank lines between their paragraphs, wrapped lines and other text around them."""
    wrap = lambda t: "\n\n".join("\n".join(textwrap.wrap(p, 72)) for p in t.split("\n\n"))
    around = "Chapter one tells of other things.\n\n" * 50
    long = {"mit": 2, "apache-2.0": 1, "isc": 0, "bsd-3-clause": 1}
    rows = [(k, around + wrap(li.TEMPLATES[name][at]) + "\n\n" + around) for k, (name, at) in enumerate(long.items())]
    rows.append((9, li.TEMPLATES["bsd-2-clause"][0].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" THIS SOFTWARE IS", "\n\nTHIS SOFTWARE IS")))
    got = {(r.doc_id, r.license) for r in li.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k, name) for k, name in enumerate(long)} <= got
    assert (9, "bsd-2-clause") in got and not {x for k, x in got if k in (0, 1, 2, 3) and x != list(long)[k]}


def test_levels_and_edges(spark):
    mit = li.TEMPLATES["mit"][2].replace("\n\n", " ")
    broken = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70))
    changed = mit.replace("Software", "Work")
    rows = [
        (1, None), (2, ""), (3, "word"), (4, "Intro text.\n\n" + mit.replace(" ", "\n", 30) + "\n\nMore text here."), (5, broken), (6, changed),
        (7, "RELEASED  under the -- mit license!"), (7, "RELEASED  under the -- mit license!"), (None, "Released under the MIT License."), (8, "no licence " * 90_000),
    ]
    docs = spark.createDataFrame([(d, t, "l", 1) for d, t in rows], "doc_id long, text string, license string, at int")
    got = {(r.doc_id, r.license): (round(r.dice, 6), r.n_lines) for r in li.licenses(docs).collect()}
    assert got[7, "mit"] == (1.0, 2) and got[None, "mit"] == (1.0, 1) and got[4, "mit"] == (1.0, 1)
    assert got[6, "mit"][0] == round(dice(mit, changed), 6)
    assert {d for d, _ in got} == {4, 5, 6, 7, None}
    assert li.licenses(docs.limit(0)).collect() == []
    assert li.scan(docs, {}).collect() == []
