"""Registry of queries and their independent SQL, plus builders for the SQL side.

The SQL gathers neighbours by reflected coordinates through joins, so it shares no mechanics with the
window plans it is compared with.
"""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES, SQL = {}, {}


def add(key, run, sql=None):
    assert key not in QUERIES, key
    QUERIES[key] = run
    if sql is not None:
        SQL[key] = str(sql)


def r6(expr, name, digits=6):
    """Rounded output column; adding 0.0 removes a negative zero."""
    e = F.expr(expr) if isinstance(expr, str) else expr
    return (F.round(e.cast("double"), digits) + F.lit(0.0)).alias(name)


def s6(expr, name=None, digits=6):
    e = f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
    return f"{e} AS {name}" if name else e


class Q:
    """A chain of common table expressions."""

    def __init__(self, *parts):
        self.parts = list(parts)

    def add(self, name, body):
        self.parts.append(f"{name} AS MATERIALIZED ({body})")
        return self

    def select(self, body):
        return "WITH RECURSIVE " + ",\n".join(self.parts) + "\n" + body

    # -- sources ------------------------------------------------------------
    def pixels(self, tiles=1, name="px"):
        pf, ps, side = tiles * tiles, tiles * tiles * 5, tiles * 8
        return self.add(name, f"""SELECT vec_id // {ps} AS stack_id, CAST((vec_id % {ps}) // {pf} AS INT) AS frame,
            CAST(((vec_id % {pf}) // {tiles}) * 8 + (i-1) // 8 AS INT) AS y, CAST(((vec_id % {pf}) % {tiles}) * 8 + (i-1) % 8 AS INT) AS x,
            {side} AS h, {side} AS w,
            CAST(greatest(0, least(255, floor(127.5 + 255 * CAST(embedding[i] AS DOUBLE) + 0.5))) AS INT) AS v
            FROM embeddings, (SELECT unnest(range(1, 65)) AS i)""")

    def frames(self, tiles=1):
        """Every frame as a stack of its own, in px."""
        return self.pixels(tiles, "px0").add("px", "SELECT * REPLACE (stack_id*5 + frame AS stack_id, CAST(0 AS INT) AS frame) FROM px0")

    def pairs(self, tiles=1):
        """Every frame with the one after it as a stack of two frames, in px."""
        return self.pixels(tiles, "px0").add("px", """SELECT * REPLACE (stack_id*5 + frame AS stack_id, CAST(0 AS INT) AS frame) FROM px0 WHERE frame < 4
            UNION ALL SELECT * REPLACE (stack_id*5 + frame - 1 AS stack_id, CAST(1 AS INT) AS frame) FROM px0 WHERE frame > 0""")

    def colour(self, src="px", name="px3"):
        return self.add(name, f"SELECT *, v AS b, (v + 3*x) % 256 AS g, (v + 5*y) % 256 AS r FROM {src}")

    def truth(self, src="px", name="truth"):
        return self.add(name, f"SELECT stack_id, y, x, h, w, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*) + 0.5) AS INT) AS t FROM {src} GROUP BY ALL")

    def masks(self, src="px", name="masks"):
        return self.add(name, f"SELECT stack_id, frame, m AS mask_id, y, x, h, w FROM {src}, (SELECT unnest(range(4)) AS m) WHERE v > 90 + 20*m")

    def obs(self, name="obs"):
        return self.add(name, """SELECT l_suppkey % 10 AS stack_id, CAST(l_linenumber AS INT) AS frame, CAST(l_partkey % 640 AS INT) AS x,
            CAST(l_orderkey % 480 AS INT) AS y, CAST(l_discount AS DOUBLE)*10 AS depth, CAST(l_tax AS DOUBLE)*100-4 AS dx,
            CAST(l_discount AS DOUBLE)*100-5 AS dy, CAST(l_quantity AS DOUBLE)/50 AS w FROM lineitem""")

    def measure(self, name="measure"):
        return self.add(name, """SELECT l_partkey % 10 AS stack_id, l_partkey AS feature_id, CAST(l_linenumber AS INT) AS frame,
            CAST(l_partkey % 640 AS DOUBLE) AS x, CAST((l_partkey // 7) % 480 AS DOUBLE) AS y,
            CASE l_partkey % 4 WHEN 0 THEN 0.6::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS nx,
            CASE l_partkey % 4 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ny,
            max(CAST(l_tax AS DOUBLE)*100-4) AS shift, max(CAST(l_quantity AS DOUBLE)/50) AS score FROM lineitem GROUP BY l_partkey, l_linenumber""")

    def scores(self, name="scores"):
        return self.add(name, "SELECT o_custkey AS scene, o_orderpriority AS method, o_orderstatus AS stratum, CAST(o_totalprice AS DOUBLE) AS value FROM orders")

    # -- neighbourhoods -----------------------------------------------------
    def gather(self, name, src, axis, taps, outs, by=("frame",), border="reflect", agg="sum", carry=()):
        """One pass along ``axis``: taps is {offset: weight}; outs is {name: column of src}."""
        other, size = ("y", "w") if axis == "x" else ("x", "h")
        rows = ", ".join(f"({o}, {float(t)!r}::DOUBLE)" for o, t in taps.items())
        c, last = f"(p.{axis} + t.o)", f"(p.{size} - 1)"
        at = {"reflect": f"CASE WHEN {c} < 0 THEN -{c} WHEN {c} > {last} THEN 2*{last} - {c} ELSE {c} END",
              "clamp": f"greatest(0, least({last}, {c}))", "none": c}[border]
        ks = ["stack_id", *by, "y", "x", "h", "w", *carry]
        weight = (lambda col: f"sum(t.k * q.{col})") if agg == "sum" else (lambda col: f"{agg}(q.{col})")
        on = " AND ".join([f"q.{k} = p.{k}" for k in ("stack_id", *by, other)] + [f"q.{axis} = {at}"])
        cols = ", ".join(f"{weight(e)} AS {n}" for n, e in outs.items())
        return self.add(name, f"""SELECT {', '.join('p.' + k for k in ks)}, {cols}
            FROM {src} p CROSS JOIN (VALUES {rows}) t(o, k) JOIN {src} q ON {on} GROUP BY {', '.join('p.' + k for k in ks)}""")

    def sep(self, name, src, tx, ty, outs, by=("frame",), carry=(), border="reflect", agg="sum"):
        """x pass with taps tx, then y pass with taps ty."""
        self.gather(name + "_x", src, "x", tx, outs, by, border, agg, carry)
        return self.gather(name, name + "_x", "y", ty, {n: n for n in outs}, by, border, agg, carry)

    def box(self, name, src, r, outs, by=("frame",), mean=True, carry=()):
        one = {o: 1.0 for o in range(-r, r + 1)}
        self.sep(name + ("_s" if mean else ""), src, one, one, outs, by, carry)
        if mean:
            ks = ["stack_id", *by, "y", "x", "h", "w", *carry]
            n = float((2 * r + 1) ** 2)
            self.add(name, f"SELECT {', '.join(ks)}, {', '.join(f'{o} / {n} AS {o}' for o in outs)} FROM {name}_s")
        return self

    def kernel(self, name, src, taps, outs, by=("frame",), carry=(), border="reflect", agg="sum"):
        """General 2-D kernel {(dy, dx): weight}."""
        rows = ", ".join(f"({dy}, {dx}, {float(t)!r}::DOUBLE)" for (dy, dx), t in taps.items())
        def at(axis, size, o):
            c, last = f"(p.{axis} + t.{o})", f"(p.{size} - 1)"
            return {"reflect": f"CASE WHEN {c} < 0 THEN -{c} WHEN {c} > {last} THEN 2*{last} - {c} ELSE {c} END",
                    "clamp": f"greatest(0, least({last}, {c}))", "none": c}[border]
        ks = ["stack_id", *by, "y", "x", "h", "w", *carry]
        weight = (lambda col: f"sum(t.k * q.{col})") if agg == "sum" else (lambda col: f"{agg}(q.{col})")
        on = " AND ".join([f"q.{k} = p.{k}" for k in ("stack_id", *by)] + [f"q.y = {at('y', 'h', 'dy')}", f"q.x = {at('x', 'w', 'dx')}"])
        return self.add(name, f"""SELECT {', '.join('p.' + k for k in ks)}, {', '.join(f'{weight(e)} AS {n}' for n, e in outs.items())}
            FROM {src} p CROSS JOIN (VALUES {rows}) t(dy, dx, k) JOIN {src} q ON {on} GROUP BY {', '.join('p.' + k for k in ks)}""")


SOBEL_X = {(dy, dx): float(dx * (2 if dy == 0 else 1)) for dy in (-1, 0, 1) for dx in (-1, 1)}
SOBEL_Y = {(dy, dx): float(dy * (2 if dx == 0 else 1)) for dy in (-1, 1) for dx in (-1, 0, 1)}
LAP3 = {(-1, -1): 2.0, (-1, 1): 2.0, (0, 0): -8.0, (1, -1): 2.0, (1, 1): 2.0}
LAP1 = {(-1, 0): 1.0, (0, -1): 1.0, (0, 0): -4.0, (0, 1): 1.0, (1, 0): 1.0}
DXX = {(0, -1): -1.0, (0, 0): 2.0, (0, 1): -1.0}
DYY = {(-1, 0): -1.0, (0, 0): 2.0, (1, 0): -1.0}


def disk_kernel(r, normalize=True):
    cells = [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if x * x + y * y <= r * r]
    return {c: (1.0 / len(cells) if normalize else 1.0) for c in cells}
