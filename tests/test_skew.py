"""Hot keys: one doctor receives a third of all visits, one rep makes a third of them,
one territory holds a third of the doctors. The decomposed plans must still equal the
naive oracle SQL on the same rows."""
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from callwise.oracles import strip_roles
from callwise.plans.registry import role_plans
from helpers import canon, roles_from_rows, rx, spark_rows, visit
from test_edges import SKIP

PRODUCTS = ["CardioMax", "DiabeCure", "NeuroCalm"]
PRICE = {"CardioMax": 850, "DiabeCure": 620, "NeuroCalm": 1100}


def skewed_rows(seed=7):
    rnd = random.Random(seed)
    terr = [(f"T{i}", f"Zone {i}", f"S{i}", ["West", "South", "East"][i % 3], 500_000 + i * 1000)
            for i in range(6)]
    reps = [(f"R{i:03d}", f"Rep {i}", f"T{i % 6}", 1 + i % 11, 200 + i) for i in range(30)]
    docs = []
    for i in range(300):
        t = "T0" if i < 100 else f"T{1 + i % 5}"          # T0 holds a third of the doctors
        pot = ["High", "Medium", "Low"][i % 3]
        docs.append((f"D{i:04d}", f"Dr {i % 40}", "GP", t, pot, 10 + i % 90, 2 + i % 28))
    visits = []
    for i in range(3000):
        doc = "D0000" if i % 3 == 0 else f"D{rnd.randrange(300):04d}"   # hot doctor
        rep = "R000" if i % 3 == 1 else f"R{rnd.randrange(30):03d}"      # hot rep
        visits.append(visit(i, rep, doc, 1 + rnd.randrange(12), rnd.choice(PRODUCTS)))
    cells = sorted({(v[2], v[6], v[4]) for v in visits})
    dterr = {d[0]: d[3] for d in docs}
    rxs = [rx(d, dterr[d], p, m, 5 + (sum(map(ord, d + p)) + m) % 40, PRICE[p]) for d, p, m in cells
           if rnd.random() < 0.5]
    return terr, reps, docs, visits, rxs


@pytest.fixture(scope="module")
def skewed(spark):
    return roles_from_rows(spark, *skewed_rows())


@pytest.fixture(scope="module")
def con(skewed):
    c = duckdb.connect()
    for name, df in skewed.as_dict().items():
        c.register(f"_{name}", pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns))
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
    return c


SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(n for n in SQL if n not in SKIP and n in role_plans()))
def test_hot_keys(skewed, con, name):
    fn, kw = role_plans()[name]
    cols, rows = spark_rows(fn(skewed, **kw))
    cur = con.execute(strip_roles(SQL[name]))
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert canon(cols, rows) == canon(dcols, cur.fetchall())


FANOUT = ["rep_scorecard", "reach_frequency", "doctor_coverage", "territory_roi", "wasted_calls"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fanout_decomposition_on_random_tables(spark, seed):
    """Several random skewed fixtures: every fan-out query (and its _dedup form) equals
    the naive SQL that materialises the join product."""
    roles = roles_from_rows(spark, *skewed_rows(seed))
    c = duckdb.connect()
    for name, df in roles.as_dict().items():
        c.register(f"_{name}", pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns))
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
    for base in FANOUT:
        for name in (base, base + "_dedup"):
            fn, kw = role_plans()[name]
            cols, rows = spark_rows(fn(roles, **kw))
            cur = c.execute(strip_roles(SQL[name]))
            dcols = [d[0] for d in cur.description]
            assert canon(cols, rows) == canon(dcols, cur.fetchall()), (seed, name)
