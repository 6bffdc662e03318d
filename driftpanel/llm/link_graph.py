"""URL filter by link-graph propagation.

Rules on hosts and paths judge the urls they fit. For the others, personalised PageRank runs over
the links between hosts: trust starts at the pages that a rule allows and follows links; distrust
starts at the pages that a rule blocks and follows links backwards, to hosts that point there. Every
seed page carries the same mass, and what has no link to follow returns to the seeds. A host whose
distrust exceeds its trust by the factor ``MARGIN`` is blocked, any other is allowed.

The graph is summed up by pair of hosts before anything else moves. Each round is one join and one
sum over it, written to the shared folder; rounds end when no host's mass moves by more than the
share ``TOLERANCE`` of itself. So the rule is the same for any number of seeds, and no round is the
last while a host is reached for the first time.

Edge cases: null urls and urls without ``://`` have an empty host and path, fit no rule and take
part in no link; they are allowed. Null html has no links. Links to the own host and relative ones
do not count. Repeated rows are pages of their own. Without seeds every host is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftpanel.llm import near
from driftpanel.session import scratch_path

#: Host, path and verdict (fixed values).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DAMPING, TOLERANCE = 0.85, 1e-4
MARGIN = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty if there is no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: list, host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits."""
    fits = []
    for own_host, own_path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        inside = (F.col(host) == own_host) | F.col(host).endswith("." + own_host)
        fits.append((inside & F.col(path).startswith(own_path), own_host + own_path, verdict))
    text = F.coalesce(*[F.when(c, F.lit(t)) for c, t, _ in fits], F.lit(None).cast("string"))
    judged = F.coalesce(*[F.when(c, F.lit(v)) for c, _, v in fits], F.lit(None).cast("string"))
    return text, judged


def arcs(pages: DataFrame) -> DataFrame:
    """``(kind, src, dst, share)``: links between hosts, forward (0) and backward (1)."""
    target = F.translate(F.col("target"), _UPPER, _LOWER)
    found = pages.where("host <> ''").select(
        F.col("host").alias("src"),
        F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), 1))).alias("target"),
    )
    links = found.select("src", target.alias("dst")).where("src <> dst")
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages"))
    both = links.select(F.lit(0).alias("kind"), "src", "dst", "pages").union(
        links.select(F.lit(1), F.col("dst"), F.col("src"), F.col("pages"))
    )
    out = both.groupBy("kind", "src").agg(F.sum("pages").alias("all"))
    return both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("pages") / F.col("all")).alias("share"))


def propagate(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """``(kind, host, mass)`` after personalised PageRank; seeds: ``(kind, host, seed)``."""
    spark = seeds.sparkSession
    written: list[str] = []

    def stored(df: DataFrame, name: str) -> DataFrame:
        written.append(scratch_path(spark, name))
        df.write.parquet(written[-1])
        return spark.read.schema(df.schema).parquet(written[-1])

    links = stored(links, "arcs")
    seeds = stored(seeds, "seeds")
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("total"))
    state = stored(seeds.withColumnRenamed("seed", "mass"), "mass")
    if links.isEmpty():
        return state
    nodes = seeds.select("kind", "host").union(links.select("kind", F.col("dst").alias("host"))).distinct()
    nodes = stored(nodes.join(seeds, ["kind", "host"], "left").fillna(0.0, ["seed"]), "nodes")
    while True:  # each round shrinks what is still to move by DAMPING
        moved = state.join(links, (state.kind == links.kind) & (state.host == links.src))
        moved = moved.groupBy(links.kind, links.dst.alias("host")).agg(
            F.sum(F.col("mass") * F.col("share")).alias("came")
        )
        # What reached no link comes back to the seeds.
        reached = moved.groupBy("kind").agg(F.sum("came").alias("kept"))
        back = total.join(reached, "kind", "left").select(
            "kind",
            (DAMPING * (1 - F.coalesce("kept", F.lit(0.0)) / F.col("total")) + 1 - DAMPING).alias("again"),
        )
        after = nodes.join(moved, ["kind", "host"], "left").join(F.broadcast(back), "kind", "left")
        mass = F.coalesce("again", F.lit(0.0)) * F.col("seed") + DAMPING * F.coalesce("came", F.lit(0.0))
        after = after.select("kind", "host", mass.alias("mass"))
        old = written[-1]
        new = stored(after, "mass")
        gap = new.join(state.withColumnRenamed("mass", "was"), ["kind", "host"], "left")
        gap = gap.select("mass", F.coalesce("was", F.lit(0.0)).alias("was")).where("mass <> was")
        gap = gap.agg(F.max(F.abs(F.col("mass") - F.col("was")) / F.greatest("mass", "was"))).first()[0] or 0.0
        if "mass-" in old:
            near.drop(spark, old)
        state = new
        if gap <= TOLERANCE:
            break
    return state


def judge_urls(
    pages: DataFrame, rules: list = RULES, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust, distrust."""
    host, path = url_parts(F.col(url))
    rule, ruled = longest_rule(rules)
    parted = pages.select(
        F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html")
    )
    judged = parted.withColumn("rule", rule).withColumn("ruled", ruled)
    seeds = judged.where("ruled is not null").groupBy(
        F.when(F.col("ruled") == "allow", 0).otherwise(1).alias("kind"), "host"
    )
    seeds = seeds.agg(F.count(F.lit(1)).cast("double").alias("pages"))
    count = F.greatest(F.lit(1.0), F.lit(float(judged.where("ruled is not null").count())))
    mass = propagate(seeds.select("kind", "host", (F.col("pages") / count).alias("seed")), arcs(parted))
    sides = mass.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("mass")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == 1, F.col("mass")).otherwise(0.0)).alias("distrust"),
    )
    sides = sides.withColumnRenamed("host", "of")
    out = judged.drop("html").join(sides, F.col("host") == F.col("of"), "left").fillna(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > MARGIN * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")
