"""SQL of the voxel measurements."""

from __future__ import annotations

from caseward.sources.derived_voxels import CELL, GEOMETRY, GROUPED, VOXEL
from oracle_sql.qc import query

REG = "(head > 0 OR body > 0 OR tail > 0)"
COM = f"(pancreas > 0 OR {REG})"


def voxel_ctes() -> list[str]:
    cell = ", ".join(f"{v} AS {k}" for k, v in CELL.items())
    grouped = ", ".join(f"{v} AS {k}" for k, v in GROUPED.items())
    voxel = ", ".join(f"{v} AS {k}" for k, v in VOXEL.items())
    geo = ", ".join(f"{v} AS {k}" for k, v in GEOMETRY.items())
    return [
        f"vc AS (SELECT {cell} FROM lineitem)",
        f"vg AS (SELECT c, z, y, x, {grouped} FROM vc GROUP BY c, z, y, x)",
        f"vv AS (SELECT {voxel} FROM vg)",
        "vox AS (SELECT * FROM vv WHERE pancreas + lesion + head + body + tail > 0)",
        f"geo AS (SELECT {geo} FROM supplier)",
        "img AS (SELECT case_id AS ic, 0.8e0 * 0.8e0 * sp AS vv3, nz AS inz, sp AS isp, ox AS iox, skew AS isk FROM geo WHERE resource = 'image')",
    ]


def mask_ctes() -> list[str]:
    one = " UNION ALL ".join(
        f"SELECT case_id, '{m}' AS mask, sum({m}) AS s, count(*) FILTER ({m} > 0) AS n,"
        + ", ".join(
            f" avg(CASE WHEN {m} > 0 THEN {a} END) AS c{a}, min(CASE WHEN {m} > 0 THEN {a} END) AS {a}_min,"
            f" max(CASE WHEN {m} > 0 THEN {a} END) AS {a}_max"
            for a in "zyx"
        )
        + " FROM vox GROUP BY case_id"
        for m in ("pancreas", "lesion", "head", "body", "tail")
    )
    return [f"ms AS (SELECT * FROM ({one}) JOIN img ON ic = case_id)"]


def component_ctes() -> list[str]:
    """Lesion components by propagating every smaller key to the neighbours."""
    return [
        "lc AS (SELECT case_id, z, y, x, (z * 4096 + y * 64 + x) AS key FROM vox WHERE lesion > 0)",
        "le AS (SELECT a.case_id, a.key AS a, b.key AS b FROM lc a JOIN lc b ON a.case_id = b.case_id"
        " AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1)",
        "reach(case_id, key, root) AS (SELECT case_id, key, key FROM lc UNION"
        " SELECT r.case_id, e.b, r.root FROM reach r JOIN le e ON e.case_id = r.case_id AND e.a = r.key)",
        "lab AS (SELECT case_id, key, min(root) AS root FROM reach GROUP BY case_id, key)",
        "num AS (SELECT case_id, root, row_number() OVER (PARTITION BY case_id ORDER BY root) AS lesion_id"
        " FROM (SELECT DISTINCT case_id, root FROM lab))",
    ]


def hole_ctes() -> list[str]:
    """Background cells of the padded grid that the outside cannot reach."""
    return [
        f"mk AS (SELECT case_id, z, y, x FROM vox WHERE {COM})",
        "grid AS (SELECT case_id, z, y, x FROM (SELECT DISTINCT case_id FROM mk), range(-1, 8) r1(z), range(-1, 13) r2(y), range(-1, 13) r3(x))",
        "bg AS (SELECT g.case_id, g.z, g.y, g.x FROM grid g ANTI JOIN mk m ON g.case_id = m.case_id AND g.z = m.z AND g.y = m.y AND g.x = m.x)",
        "outs(case_id, z, y, x) AS (SELECT case_id, z, y, x FROM bg WHERE z = -1 UNION"
        " SELECT b.case_id, b.z, b.y, b.x FROM outs o, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) d(dz, dy, dx), bg b"
        " WHERE b.case_id = o.case_id AND b.z = o.z + dz AND b.y = o.y + dy AND b.x = o.x + dx)",
        "hole AS (SELECT b.case_id, b.z, b.y, b.x FROM bg b ANTI JOIN outs o ON b.case_id = o.case_id AND b.z = o.z AND b.y = o.y AND b.x = o.x)",
    ]


def core_ctes() -> list[str]:
    nb = " AND ".join(
        f"EXISTS (SELECT 1 FROM org n WHERE n.case_id = o.case_id AND n.z = o.z + ({dz}) AND n.y = o.y + ({dy}) AND n.x = o.x + ({dx}))"
        for dz, dy, dx in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
    )
    return [
        "org AS (SELECT case_id, z, y, x, hu FROM vox WHERE pancreas > 0 AND lesion = 0)",
        f"core AS (SELECT * FROM org o WHERE {nb})",
    ]


def hu_ctes() -> list[str]:
    def stats(name: str) -> str:
        return (
            f"count(*) AS {name}_n, round_even(avg(hu), 2) AS {name}_mean, round_even(stddev_pop(hu), 2) AS {name}_std, "
            + ", ".join(
                f"round_even(quantile_cont(hu::DOUBLE, {p}), 2) AS {name}_{k}"
                for p, k in ((0.05, "p05"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95"))
            )
        )

    return core_ctes() + [
        "cn AS (SELECT case_id, count(*) AS n FROM core GROUP BY case_id)",
        "ref AS (SELECT * FROM core WHERE case_id IN (SELECT case_id FROM cn WHERE n >= 50) UNION ALL"
        " SELECT * FROM org WHERE case_id NOT IN (SELECT case_id FROM cn WHERE n >= 50))",
        "bnd AS (SELECT case_id AS bc, quantile_cont(hu::DOUBLE, 0.05) AS lo, quantile_cont(hu::DOUBLE, 0.95) AS hi FROM ref GROUP BY case_id)",
        "clip AS (SELECT ref.* FROM ref JOIN bnd ON bc = case_id WHERE hu BETWEEN lo AND hi)",
        "cc AS (SELECT case_id, count(*) AS n FROM clip GROUP BY case_id)",
        "fin AS (SELECT * FROM clip WHERE case_id IN (SELECT case_id FROM cc WHERE n >= 50) UNION ALL"
        " SELECT * FROM ref WHERE case_id NOT IN (SELECT case_id FROM cc WHERE n >= 50))",
        f"ps AS (SELECT case_id AS pc, {stats('p')} FROM fin GROUP BY case_id)",
        f"ts AS (SELECT case_id AS tc, {stats('t')} FROM vox WHERE lesion > 0 GROUP BY case_id)",
        "hs AS (SELECT case_id, ps.*, ts.* FROM (SELECT DISTINCT case_id FROM vox) LEFT JOIN ps ON pc = case_id LEFT JOIN ts ON tc = case_id)",
        "h1 AS (SELECT *, CASE WHEN t_n > 0 AND p_n > 0 THEN round_even(t_median - p_median, 2) END AS delta FROM hs)",
        "h2 AS (SELECT *, CASE WHEN delta IS NOT NULL AND p_std > 0.001e0 AND p_std < 200 THEN round_even(delta / p_std, 4) END AS zs,"
        " CASE WHEN delta < -10 THEN 'Hypo' WHEN delta > 10 THEN 'Hyper' WHEN delta IS NOT NULL THEN 'Iso' END AS dl FROM h1)",
        "h3 AS (SELECT *, CASE WHEN zs < -2 THEN 'Hypo' WHEN zs > 2 THEN 'Hyper' WHEN zs IS NOT NULL THEN 'Iso' END AS zl FROM h2)",
    ]


def recursive(ctes: list[str], select: str) -> str:
    """Recursive steps cannot be materialised and need the RECURSIVE keyword."""
    steps = []
    for c in ctes:
        name = c.split(" AS (", 1)[0]
        steps.append(c if "(" in name else c.replace(" AS (", " AS MATERIALIZED (", 1))
    return "WITH RECURSIVE " + ",\n".join(steps) + "\n" + select


__all__ = ["query", "recursive", "voxel_ctes", "mask_ctes", "component_ctes", "hole_ctes", "hu_ctes"]
