"""DuckDB SQL of the seeding and of a relocating step of k-means, written out step by step."""

from __future__ import annotations

from callwise.operators.kmeans import COST_UNIT, HASH_STREAM, MIX1, MIX2, UNIT, code, trials
from callwise.oracles_bi import _draw
from callwise.oracles_more import FEATURES, feat

WORD = "CAST(18446744073709551616 AS UHUGEINT)"
X = [f"x{i}" for i in range(len(FEATURES))]

POINTS = "pts AS MATERIALIZED (SELECT doctor_id, " + _draw(["doctor_id"], HASH_STREAM) + " AS h, " + ", ".join(
    f"CAST(floor({c} * {UNIT} + 0.5) AS BIGINT) AS q{i}, floor({c} * {UNIT} + 0.5) / {UNIT} AS x{i}"
    for i, c in enumerate(FEATURES)) + " FROM scaled)"


def _times(x: str, by: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * CAST({by} AS UHUGEINT)) % {WORD} AS UBIGINT)"


def _uniform(salt: int) -> str:
    x = f"CAST((CAST(h AS UHUGEINT) + CAST({salt} AS UHUGEINT)) % {WORD} AS UBIGINT)"
    x = _times(f"xor({x}, {x} >> 30)", MIX1)
    x = _times(f"xor({x}, {x} >> 27)", MIX2)
    x = f"xor({x}, {x} >> 31)"
    return f"((CAST(({x}) >> 11 AS DOUBLE) + 0.5) * {2.0 ** -53!r})"


def _apart(a: str, b: str) -> str:
    return " + ".join(f"({a}.{x} - {b}.{x}) * ({a}.{x} - {b}.{x})" for x in X)


def seeding_sql(k: int, seed: int) -> str:
    xs = ", ".join(X)
    ctes = [POINTS,
            f"t1 AS MATERIALIZED (SELECT 0 AS trial, doctor_id, {xs} FROM pts ORDER BY -ln({_uniform(code(seed, 1, 0))}), h LIMIT 1)",
            f"c1 AS MATERIALIZED (SELECT t.*, (SELECT SUM(CAST(floor(({_apart('p', 't')}) * {COST_UNIT}) AS BIGINT)) FROM pts p) AS cost FROM t1 t)",
            f"d1 AS MATERIALIZED (SELECT p.*, {_apart('p', 'c')} AS d FROM pts p, c1 c)"]
    for s in range(2, k + 1):
        before = f"d{s - 1}"
        drawn = " UNION ALL ".join(
            f"(SELECT {t} AS trial, doctor_id, {xs} FROM {before} ORDER BY CASE WHEN d = 0 THEN CAST('Infinity' AS DOUBLE) "
            f"ELSE -ln({_uniform(code(seed, s, t))}) / d END, h LIMIT 1)" for t in range(trials(k)))
        ctes += [f"t{s} AS MATERIALIZED ({drawn})",
                 f"c{s} AS MATERIALIZED (SELECT t.trial, t.doctor_id, {', '.join('t.' + x for x in X)}, "
                 f"SUM(CAST(floor(least(p.d, {_apart('p', 't')}) * {COST_UNIT}) AS BIGINT)) AS cost "
                 f"FROM t{s} t, {before} p GROUP BY ALL ORDER BY cost, trial LIMIT 1)",
                 f"d{s} AS MATERIALIZED (SELECT p.* EXCLUDE (d), least(p.d, {_apart('p', 'c')}) AS d FROM {before} p, c{s} c)"]
    body = " UNION ALL ".join(f"SELECT CAST({s} AS INT) AS step, doctor_id, CAST(trial AS INT) AS trial, CAST(cost AS BIGINT) AS cost FROM c{s}"
                              for s in range(1, k + 1))
    return feat(body, ",\n".join(ctes))


def relocation_sql(far: float) -> str:
    """One empty cluster, the one far out."""
    ctes = [POINTS,
            "start AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY cluster) - 1 AS cluster, " + ", ".join(f"c_{c} AS x{i}" for i, c in enumerate(FEATURES))
            + " FROM (SELECT * FROM centroids UNION ALL SELECT 99, " + ", ".join(["CAST(%r AS DOUBLE)" % far] * len(FEATURES)) + "))",
            f"own AS MATERIALIZED (SELECT p.*, s.cluster, {_apart('p', 's')} AS d FROM pts p, start s QUALIFY ROW_NUMBER() OVER (PARTITION BY doctor_id ORDER BY d, cluster) = 1)",
            "moved AS MATERIALIZED (SELECT * FROM own ORDER BY d DESC, h LIMIT 1)",
            "kept AS (SELECT o.* EXCLUDE (cluster), CASE WHEN o.doctor_id = m.doctor_id THEN (SELECT MAX(cluster) FROM start) ELSE o.cluster END AS cluster FROM own o, moved m)"]
    return feat("SELECT CAST(cluster AS INT) AS cluster, COUNT(*) AS n_doctors, " + ", ".join(
        f"CAST(SUM(q{i}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) / {UNIT} AS {c}" for i, c in enumerate(FEATURES)) + " FROM kept GROUP BY cluster", ",\n".join(ctes))


def kmeans_sql() -> dict[str, str]:
    from callwise.plans.segments import FAR, SEED
    return {"kmeans_seeding": seeding_sql(3, SEED), "kmeans_relocation": relocation_sql(FAR)}
