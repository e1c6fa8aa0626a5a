from pyspark.sql import functions as F

from .. import adapters as A
from ..shared import place
from ..sources import figures
from ..sources.each import parsed
from . import query

T = A.table


@query("SELECT 'r' || r AS profile_key, n AS name, s AS settings, a AS active FROM (SELECT DISTINCT n_regionkey AS r FROM nation) CROSS JOIN (VALUES ('main', '{\"w\": 2}', false), ('copy', '{\"w\": 2}', true)) t(n, s, a)")
def k15_settings_store(spark, sf_dir):
    """Settings written, changed, copied, activated and deleted, each as a version of its own."""
    path = place(spark, "settings")
    key = F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("profile_key")
    keys = T(spark, sf_dir, "nation").select(key).distinct()
    row = lambda name, s, deleted=False, active=False: keys.select("profile_key", F.lit(name).alias("name"), F.lit(s).alias("settings"), F.lit(deleted).alias("deleted"), F.lit(active).alias("active"))
    figures.log_settings(spark, path, row("main", '{"w": 1}', active=True).unionByName(row("old", "{}")))
    figures.log_settings(spark, path, row("main", '{"w": 2}').unionByName(row("old", "{}", deleted=True)))
    figures.log_settings(spark, path, figures.copied(figures.settings(spark, path), "main", "copy"))
    figures.log_settings(spark, path, row("copy", '{"w": 2}', active=True))
    return figures.settings(spark, path)


SERIES = f"WITH {A.SAMPLES_SQL}, s AS (SELECT g, side, d::DOUBLE AS x, count(*)::DOUBLE AS y FROM samples GROUP BY ALL), l AS (SELECT g, min(x) AS ax, max(x) AS zx, min(y) AS ay, max(y) AS zy FROM s GROUP BY g), p AS (SELECT s.g, side, string_agg(floor(coalesce((x - ax) / nullif(zx - ax, 0), 0.5) * 640)::INT || ',' || floor((1 - coalesce((y - ay) / nullif(zy - ay, 0), 0.5)) * 400)::INT, ' ' ORDER BY x) AS points FROM s JOIN l USING (g) GROUP BY ALL)"


def curves(spark, sf_dir):
    return A.samples(spark, sf_dir).groupBy("g", "side", F.col("d").cast("double").alias("x")).agg(F.count("*").cast("double").alias("y"))


@query(f"{SERIES} SELECT g, side, points FROM p")
def k19_polylines(spark, sf_dir):
    return figures.polylines(curves(spark, sf_dir), "g", "side", "x", "y")


@query(f"""{SERIES} SELECT g, '<svg viewBox="0 0 640 400">' || string_agg('<polyline fill="none" data-name="' || side || '" points="' || points || '"/>', '' ORDER BY side) || '</svg>' AS value FROM p GROUP BY g""")
def k19_line_figures(spark, sf_dir):
    return figures.svg_lines(curves(spark, sf_dir), "g", "side", "x", "y")


@query(f"""WITH {A.SAMPLES_SQL}, c AS (SELECT g, n AS i, d AS j, count(*) AS v FROM samples GROUP BY ALL), t AS (SELECT g, max(v) AS top, max(i) + 1 AS nx, max(j) + 1 AS ny FROM c GROUP BY g)
SELECT c.g, '<svg viewBox="0 0 ' || any_value(nx * 8) || ' ' || any_value(ny * 8) || '">' || string_agg('<rect x="' || i * 8 || '" y="' || (ny - 1 - j) * 8 || '" opacity="' || floor(v / top::DOUBLE * 100)::INT || '%"/>', '' ORDER BY i, j) || '</svg>' AS value FROM c JOIN t USING (g) GROUP BY c.g""")
def k19_heatmap_figures(spark, sf_dir):
    cells = A.samples(spark, sf_dir).groupBy("g", F.col("n").alias("i"), F.col("d").alias("j")).agg(F.count("*").alias("v"))
    return figures.svg_heatmap(cells, "g", "i", "j", "v")


def asked(spark, sf_dir, options):
    k = F.col("n_nationkey")
    return T(spark, sf_dir, "nation").select(k.alias("source"), F.element_at(F.array(*map(F.lit, options)), (k % len(options) + 1).cast("int")).alias("text"))


@query("SELECT n_nationkey AS source, (['', 'axis', 'axis,species'])[n_nationkey % 4 + 1] AS missing FROM nation WHERE n_nationkey % 4 < 3")
def x3_action_registry(spark, sf_dir):
    def parse(t):
        known = figures.Actions()
        known.register("density", ("axis", "species"))
        name, _, rest = t.partition(" ")
        return [(",".join(known.missing(name, dict(p.split("=") for p in rest.split()))),)]

    return parsed(asked(spark, sf_dir, ("density axis=z species=O", "density species=O", "density", "unknown")), parse, "missing string")


@query("SELECT n_nationkey AS source, (['preferred', 'allowed', 'invalid', 'preferred', 'invalid', 'invalid', 'invalid'])[n_nationkey % 7 + 1] AS verdict FROM nation")
def x5_plot_contracts(spark, sf_dir):
    def parse(t):
        c = figures.Contract({"time": ("frame",), "z": ("bin",), "density": ("bin",), "position": ("frame", "atom"), "map": ("bin", "frame"), "label": ("bin",)}, texts=frozenset(["label"]))
        view, *roles = t.split()
        return [(c.verdict(view, **dict(r.split("=") for r in roles)),)]

    options = ("line x=z y=density", "line x=time y=position", "line x=z y=time", "heatmap x=z y=time z=map", "heatmap x=z y=density z=map", "line x=z y=label", "scatter x=z y=density")
    return parsed(asked(spark, sf_dir, options), parse, "verdict string")
