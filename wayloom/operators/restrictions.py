"""Turn restrictions: relations of ways at a node as forbidden pairs of arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.geo import turn_angle


def maneuver(value: Column) -> Column:
    out = F.lit("any")
    for word, name in (("straight", "straight"), ("right", "right"), ("left", "left"), ("u_turn", "u")):
        out = F.when(value.contains(word), name).otherwise(out)
    return out


def turn_class(angle: Column) -> Column:
    """Up to 45 degrees straight, from 150 a U-turn, else left or right."""
    return F.when(F.abs(angle) <= 45, "straight").when(F.abs(angle) >= 150, "u").when(angle > 0, "right").otherwise("left")


def forbidden_turns(relations: DataFrame, arcs: DataFrame) -> DataFrame:
    """(in_arc, out_arc) from relations (rel, from_ways, via, to_ways, value) and arcs (arc, way, tail, head, bearing).

    A `no` relation forbids the pairs of its ways that make its turn; the only pair there is counts without looking at
    its angle. An `only` relation forbids, from the arcs that can make its turn (else all its from arcs), every other
    way out of the node.
    """
    r = relations.withColumns({"only": F.col("value").startswith("only"), "turn": maneuver(F.col("value"))})
    a = arcs.select("arc", "way", "tail", "head", "bearing")
    into = r.select("rel", "via", "only", "turn", F.explode("from_ways").alias("way")).join(a.withColumnRenamed("head", "via"), ["way", "via"])
    into = into.select("rel", "via", "only", "turn", F.col("arc").alias("in_arc"), F.col("bearing").alias("b_in")).distinct()
    out = r.select("rel", "via", F.explode("to_ways").alias("way")).join(a.withColumnRenamed("tail", "via"), ["way", "via"])
    out = out.select("rel", F.col("arc").alias("out_arc"), F.col("bearing").alias("b_out")).distinct()
    n = F.count("*").over(Window.partitionBy("rel"))
    pairs = into.join(out, "rel").withColumns({"n": n, "class": turn_class(turn_angle(F.col("b_in"), F.col("b_out")))})
    named = pairs.where((F.col("n") == 1) | (F.col("turn") == "any") | (F.col("class") == F.col("turn")))
    no = named.where("not only").select("in_arc", "out_arc")
    # of only-relations: what they allow, and the arcs that they bind
    only = pairs.where("only")
    hit = named.where("only").select("rel").distinct()
    allowed = named.where("only").select("rel", "in_arc", "out_arc").unionByName(only.join(hit, "rel", "left_anti").select("rel", "in_arc", "out_arc"))
    bound = allowed.select("rel", "in_arc").unionByName(into.where("only").join(only.select("rel").distinct(), "rel", "left_anti").select("rel", "in_arc")).distinct()
    ways_out = bound.join(into.select("rel", "via").distinct(), "rel").join(a.select(F.col("tail").alias("via"), F.col("arc").alias("out_arc")), "via").select("rel", "in_arc", "out_arc")
    rest = ways_out.join(allowed, ["rel", "in_arc", "out_arc"], "left_anti").select("in_arc", "out_arc")
    return no.unionByName(rest).distinct()


def relations(rows: DataFrame) -> DataFrame:
    """(rel, from_ways, via, to_ways, value) of relations (rel, tags map<string,string>, members array<struct<kind,ref,role>>) that restrict
    turns at a node at all times: of several nodes via the last counts; relations via ways, and those without ways from or to, are left out."""
    ways = lambda role: F.transform(F.filter("members", lambda m: (m["role"] == role) & (m["kind"] == "way")), lambda m: m["ref"])
    via = F.filter("members", lambda m: m["role"] == "via")
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    r = rows.where((tag("type") == "restriction") & tag("restriction").isNotNull())
    r = r.select("rel", ways("from").alias("from_ways"), via.alias("via"), ways("to").alias("to_ways"), tag("restriction").alias("value"))
    r = r.where((F.size("from_ways") > 0) & (F.size("to_ways") > 0) & (F.size("via") > 0) & F.forall("via", lambda m: m["kind"] == "node"))
    return r.select("rel", "from_ways", F.element_at("via", -1)["ref"].alias("via"), "to_ways", "value")
