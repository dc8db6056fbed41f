"""Access-list analysis: pairs inside a short list, no pairs in a long one.

A list of up to ``SHORT`` entries is gathered in a row and its entries are compared there: the entries are moved once, by list, and not at all if they are dealt
out by list already.  Longer lists are found by one count when a query is built, and take the way below.

An entry can cover another only if its source and destination networks contain the other's,
so candidates are found by equality: each inner entry is masked to the prefix lengths that
occur in its list and looked up by (list, protocol key, source prefix, destination prefix, aligned run of ports).
Entries are first reduced to distinct shapes with their lowest sequence number per action,
which is all the classification needs; repeated entries therefore cost nothing, and a list that
holds a third of all rows is spread over its prefixes by the join key.

Comparisons that are undecided because an outer address is unresolved need only existence, and
are looked up the same way on the resolved side.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.functions.netaddr import NET, let, network
from fleetsift.session import cut_lineage

UNIVERSAL = ("any", "ip")
SHAPE = ["proto", "proto_num", "src", "dst", "sp_lo", "sp_hi", "dp_lo", "dp_hi", "established"]
FIRSTS = ("first_permit", "first_deny", "first_seq")
#: Entries of a list that are compared inside its row; a longer list is never gathered.
SHORT = 256
KINDS = ("shadowed", "redundant", "overly_permissive", "undetermined")


def active(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("disabled"))


def networks(kind: Column, cidrs: Column) -> Column:
    """Sorted networks of an address: both families for ``any``, NULL when unresolved."""
    whole = [(4, "0" * 32, "0" * 24 + "f" * 8), (6, "0" * 32, "f" * 32)]
    both = F.array(*[F.struct(F.lit(v).alias("ver"), F.lit(0).alias("len"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for v, lo, hi in whole])
    nets = F.array_sort(F.transform(cidrs, network))
    return F.when(kind == "any", both).when(F.size(cidrs) > 0, nets)


def net_covers(outer: Column, inner: Column) -> Column:
    """Every inner network inside some outer one of the same family; NULL when either is NULL."""
    return F.when(
        outer.isNotNull() & inner.isNotNull(),
        F.forall(inner, lambda i: F.exists(outer, lambda o: (o["ver"] == i["ver"]) & (o["lo"] <= i["lo"]) & (o["hi"] >= i["hi"]))),
    )


def port_covers(o_lo: Column, o_hi: Column, i_lo: Column, i_hi: Column) -> Column:
    return (o_lo <= i_lo) & (i_hi <= o_hi)


def ports_overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return (a_lo <= b_hi) & (b_lo <= a_hi)


def proto_covers(outer: Column, inner: Column, outer_num: Column, inner_num: Column) -> Column:
    o, i = F.lower(outer), F.lower(inner)
    return (
        F.when(o.isin(*UNIVERSAL), F.lit(True))
        .when(i.isin(*UNIVERSAL), F.lit(False))
        .when(o == i, F.lit(True))
        .when(outer_num.isNotNull() & inner_num.isNotNull(), outer_num == inner_num)
        .otherwise(F.lit(False))
    )


def shape_id(cols: list[str]) -> Column:
    """Content address of everything an entry matches on."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def with_shape(entries: DataFrame) -> DataFrame:
    return entries.withColumn("shape", shape_id(SHAPE))


def shapes(entries: DataFrame) -> DataFrame:
    """Distinct match shapes of each list with the lowest sequence number per action.

    Several lookups read this table, so it is computed once and kept in the checkpoint folder.
    """
    grouped = with_shape(entries).groupBy("acl_id", "shape").agg(
        *[F.first(c).alias(c) for c in SHAPE],
        F.min(F.when(F.col("action") == "permit", F.col("seq"))).alias("first_permit"),
        F.min(F.when(F.col("action") == "deny", F.col("seq"))).alias("first_deny"),
        F.min("seq").alias("first_seq"),
    )
    return cut_lineage(grouped)


def _mask(net: Column, length: Column) -> Column:
    """Key text of ``net`` cut to ``length`` bits: family, length and the leading hex digits."""
    bits = F.when(net["ver"] == 4, length + 96).otherwise(length)
    digits = (bits / 4).cast("int")
    rest = bits % 4
    nibble = F.conv(F.substring(net["lo"], digits + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2), F.lit(4) - rest).cast("int")
    tail = F.when(rest > 0, (nibble - nibble % step).cast("string")).otherwise("")
    return F.concat_ws(":", net["ver"].cast("string"), length.cast("string"), F.substring(net["lo"], F.lit(1), digits), tail)


def _proto_keys(inner: bool) -> Column:
    """Equality keys of a protocol: an inner entry also asks for the universal ones."""
    name = F.lower(F.col("proto"))
    own = F.when(name.isin(*UNIVERSAL), F.lit("*")).otherwise(F.concat(F.lit("n:"), name))
    number = F.when(~name.isin(*UNIVERSAL) & F.col("proto_num").isNotNull(), F.concat(F.lit("#"), F.col("proto_num")))
    keys = F.array(own, number, F.lit("*")) if inner else F.array(own, number)
    return F.array_distinct(F.array_compact(keys))


def _port_level() -> Column:
    """Least ``n`` for which the destination ports of a shape fit a run of ``2 ** n``."""
    span = F.col("dp_hi") - F.col("dp_lo")
    return F.when(span <= 0, 0).when(span > 0, F.length(F.bin(span)))


def _port_block(port: Column, level: Column) -> Column:
    return F.floor(port / F.pow(F.lit(2), level)).cast("int")


def _outer_keys(outer: DataFrame, *sides: str) -> DataFrame:
    """Outer shapes exploded to one row per protocol key, network combination and aligned port run (two at most) that they touch."""
    level = _port_level()
    runs = F.array_distinct(F.array(_port_block(F.col("dp_lo"), level), _port_block(F.col("dp_hi"), level)))
    out = outer.withColumn("pk", F.explode(_proto_keys(False))).withColumn("port_level", level).withColumn("port_key", F.explode(runs))
    for side in sides:
        out = out.withColumn(f"{side}_net", F.explode(side)).withColumn(f"{side}_key", _mask(F.col(f"{side}_net"), F.col(f"{side}_net.len")))
        out = out.withColumn(f"{side}_form", F.struct(F.col(f"{side}_net.ver").alias("ver"), F.col(f"{side}_net.len").alias("len"))).drop(f"{side}_net")
    return out


def _candidates(inner: DataFrame, outer: DataFrame, *sides: str) -> DataFrame:
    """(inner, outer) shape pairs whose anchor networks nest on the given sides.

    The anchor of an inner address is its first network, that of its destination ports the lowest one.  Only prefix forms and port
    run lengths that occur in the list are tried, so an inner shape is expanded by the few its list uses.
    """
    keyed = _outer_keys(outer, *sides)
    forms = [f"{s}_form" for s in sides]
    used = keyed.groupBy("acl_id").agg(F.collect_set(F.struct("port_level", *forms)).alias("forms"))
    asked = inner.withColumn("pk", F.explode(_proto_keys(True))).join(used, "acl_id").withColumn("form", F.explode("forms")).drop("forms")
    asked = asked.where(F.col("form.port_level") >= _port_level()).withColumn("port_level", F.col("form.port_level"))
    asked = asked.withColumn("port_key", _port_block(F.col("dp_lo"), F.col("port_level")))
    for s in sides:
        anchor, form = F.col(s)[0], F.col(f"form.{s}_form")
        asked = asked.where((form["ver"] == anchor["ver"]) & (form["len"] <= anchor["len"])).withColumn(f"{s}_key", _mask(anchor, form["len"]))
    asked = asked.drop("form")
    on = ["acl_id", "pk", "port_level", "port_key", *[f"{s}_key" for s in sides]]
    i = asked.select(*on, F.col("shape").alias("i"), *[F.col(c).alias(f"i_{c}") for c in SHAPE])
    o = keyed.select(*on, F.col("shape").alias("o"), *[F.col(c).alias(f"o_{c}") for c in SHAPE], *FIRSTS)
    return i.join(o, on)


def _residual(*sides: str) -> Column:
    """The parts of coverage that equality keys do not decide."""
    o, i = ({c: F.col(f"{side}_{c}") for c in SHAPE} for side in "oi")
    return _covers(o, i, *sides)


def _covers(o: Mapping[str, Column] | Column, i: Mapping[str, Column] | Column, *sides: str) -> Column:
    """Whether the outer entry matches whatever the inner one does, as far as its addresses on ``sides`` say."""
    cond = (
        (~o["established"] | i["established"])
        & port_covers(o["sp_lo"], o["sp_hi"], i["sp_lo"], i["sp_hi"])
        & port_covers(o["dp_lo"], o["dp_hi"], i["dp_lo"], i["dp_hi"])
        & proto_covers(o["proto"], i["proto"], o["proto_num"], i["proto_num"])
    )
    for s in sides:
        cond = cond & net_covers(o[s], i[s])
    return cond


def _resolved() -> Column:
    return F.col("src").isNotNull() & F.col("dst").isNotNull()


def shape_cover(distinct: DataFrame, once: bool = True) -> DataFrame:
    """Covering pairs of resolved shapes: ``acl_id, i, o, first_*``.

    An outer shape with several networks may meet an anchor twice; pairs are made distinct unless the caller only takes
    minima, which repeats leave alone.
    """
    rows = distinct.where(_resolved())
    pairs = _candidates(rows.select("acl_id", "shape", *SHAPE), rows, "src", "dst").where(_residual("src", "dst"))
    pairs = pairs.select("acl_id", "i", "o", "first_permit", "first_deny", "first_seq")
    return pairs.distinct() if once else pairs


def unresolved_above(distinct: DataFrame) -> DataFrame:
    """Lowest sequence number of an entry whose coverage of a shape is undecided."""
    inner = distinct.where(_resolved()).select("acl_id", "shape", *SHAPE)
    src_open, dst_open = F.col("src").isNull(), F.col("dst").isNull()
    found = None
    for rows, sides in (
        (distinct.where(src_open & ~dst_open), ("dst",)),
        (distinct.where(~src_open & dst_open), ("src",)),
        (distinct.where(src_open & dst_open), ()),
    ):
        if sides:
            asked = inner
        else:
            # Addresses play no part here: both sides shrink to protocol and port shapes.
            asked, rows = _ports_only(inner), _ports_only(rows)
        hits = _candidates(asked, rows, *sides).where(_residual(*sides))
        part = hits.groupBy("acl_id", "i").agg(F.min("first_seq").alias("open_seq"))
        if not sides:
            full = inner.select("acl_id", F.col("shape").alias("full"), _bare().alias("i"))
            part = full.join(part, ["acl_id", "i"]).select("acl_id", F.col("full").alias("i"), "open_seq")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("acl_id", "i").agg(F.min("open_seq").alias("open_seq"))


_BARE = [c for c in SHAPE if c not in ("src", "dst")]


def _bare() -> Column:
    return shape_id(_BARE)


def _ports_only(rows: DataFrame) -> DataFrame:
    firsts = [c for c in FIRSTS if c in rows.columns]
    null_nets = [F.lit(None).cast(f"array<{NET}>").alias(c) for c in ("src", "dst")]
    grouped = rows.select("acl_id", _bare().alias("bare"), *_BARE, *firsts).groupBy("acl_id", "bare").agg(
        *[F.first(c).alias(c) for c in _BARE], *[F.min(c).alias(c) for c in firsts]
    )
    return grouped.select("acl_id", F.col("bare").alias("shape"), *_BARE, *null_nets, *firsts)


# ---- short lists ---------------------------------------------------------------------


def long_lists(live: DataFrame, limit: int = SHORT) -> DataFrame:
    """Ids of the lists of more than ``limit`` entries, at most one for so many entries; counted once and kept in the checkpoint folder."""
    return cut_lineage(live.groupBy("acl_id").agg(F.count("*").alias("n")).where((F.col("n") > limit) & F.col("acl_id").isNotNull()).select("acl_id"))


def _split(live: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Entries of the short lists, and those of the long ones if there are any.  Entries of no list belong to neither."""
    known = live.where(F.col("acl_id").isNotNull())
    long = long_lists(live, limit)
    if long.isEmpty():
        return known, None
    return known.join(long, "acl_id", "left_anti"), known.join(long, "acl_id", "left_semi")


def _gathered(short: DataFrame) -> DataFrame:
    """One row per list: ``acl_id`` and its entries as ``all``."""
    return short.groupBy("acl_id").agg(F.collect_list(F.struct(*[c for c in short.columns if c != "acl_id"])).alias("all"))


def _known(e: Column) -> Column:
    return e["src"].isNotNull() & e["dst"].isNotNull()


def _covering(i: Column) -> Column:
    """Entries of the row's list that come before ``i`` and cover it."""
    first = F.filter("all", lambda o: (o["seq"] < i["seq"]) & _known(o) & _covers(o, i))
    return F.when(_known(i), F.filter(first, lambda o: net_covers(o["src"], i["src"]) & net_covers(o["dst"], i["dst"])))


def _undecided(i: Column) -> Column:
    """Whether an entry before ``i`` covers it or not depending on an address that is not resolved."""
    side = lambda o, c: o[c].isNull() | net_covers(o[c], i[c])
    return F.exists("all", lambda o: F.coalesce((o["seq"] < i["seq"]) & ~_known(o) & _covers(o, i) & side(o, "src") & side(o, "dst"), F.lit(False)))


def _is_same(o: Column, i: Column) -> Column:
    """An entry that is no permit counts as a deny, but only a deny makes it redundant."""
    return F.when(F.coalesce(i["action"] == "permit", F.lit(False)), o["action"] == "permit").otherwise(o["action"] == "deny")


def _is_other(o: Column, i: Column) -> Column:
    return F.when(F.coalesce(i["action"] == "permit", F.lit(False)), o["action"] == "deny").otherwise(o["action"] == "permit")


def _classified_short(short: DataFrame) -> DataFrame:
    """Entries of short lists with ``kind``."""

    def judged(i: Column) -> Column:
        kind = lambda first: (
            F.when(~_known(i), "undetermined").when(F.exists(first, lambda o: F.coalesce(_is_other(o, i), F.lit(False))), "shadowed")
            .when(F.exists(first, lambda o: F.coalesce(_is_same(o, i), F.lit(False))), "redundant").when(_undecided(i), "undetermined")
        )
        return let(_covering(i), lambda first: F.struct(i.alias("e"), kind(first).alias("kind")))

    rows = _gathered(short).select("acl_id", F.inline(F.transform("all", judged)))
    return rows.select("acl_id", "e.*", "kind").select(*short.columns, "kind")


# ---- queries of both -----------------------------------------------------------------


def classify(entries: DataFrame, limit: int = SHORT) -> DataFrame:
    """Observation kind of each active entry, NULL for a clean one: one row per entry.

    Shadowed beats redundant beats undetermined; an entry with an unresolved address is
    undetermined whatever lies above it.
    """
    live = active(entries)
    short, long = _split(live, limit)
    # An entry of no list has nothing above it.
    alone = live.where(F.col("acl_id").isNull()).withColumn("kind", F.when(~_resolved(), "undetermined"))
    rows = _classified_short(short).unionByName(alone)
    if long is not None:
        rows = rows.unionByName(_classified_long(long, shapes(long)).drop("shape"))
    reason = F.when(~_resolved(), "unresolved_object").when(F.col("kind") == "undetermined", "unresolved_earlier_entry")
    return rows.select(*entries.columns, "kind", reason.alias("unresolved_reason"), permissive().alias("is_permissive"))


def _classified_long(live: DataFrame, distinct: DataFrame) -> DataFrame:
    """Entries with their ``shape`` and ``kind``, by lookups of their shapes."""
    best = shape_cover(distinct, once=False).groupBy("acl_id", F.col("i").alias("shape")).agg(
        F.min("first_permit").alias("permit_seq"), F.min("first_deny").alias("deny_seq")
    )
    undecided = unresolved_above(distinct).withColumnRenamed("i", "shape")
    # Verdict bounds are joined per shape first, then once to the entries.
    bounds = best.join(undecided, ["acl_id", "shape"], "full_outer")
    rows = with_shape(live).join(bounds, ["acl_id", "shape"], "left")
    same = F.when(F.col("action") == "permit", F.col("permit_seq")).otherwise(F.col("deny_seq")) < F.col("seq")
    other = F.when(F.col("action") == "permit", F.col("deny_seq")).otherwise(F.col("permit_seq")) < F.col("seq")
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = (
        F.when(~_resolved(), "undetermined").when(yes(other), "shadowed").when(yes(same), "redundant")
        .when(yes(F.col("open_seq") < F.col("seq")), "undetermined")
    )
    return rows.select(*live.columns, "shape", kind.alias("kind"))


def permissive() -> Column:
    """Permits any protocol from any to any on any destination port; source ports do not count."""
    return (
        (F.col("action") == "permit") & (F.col("src_kind") == "any") & (F.col("dst_kind") == "any")
        & F.lower("proto").isin(*UNIVERSAL) & (F.col("dp_lo") == 0) & (F.col("dp_hi") == 65535)
    )


def observations(entries: DataFrame) -> DataFrame:
    """One row per observation: overly permissive entries first, then the entry's own kind."""
    rows = classify(entries)
    severity = F.create_map(*[F.lit(x) for kv in (("shadowed", "medium"), ("redundant", "low"), ("overly_permissive", "high"), ("undetermined", "info")) for x in kv])
    kinds = F.array_compact(F.array(F.when(F.col("is_permissive"), F.lit("overly_permissive")), F.col("kind")))
    return (
        rows.select("acl_id", "seq", "unresolved_reason", F.explode_outer(kinds).alias("kind"))
        .where(F.col("kind").isNotNull())
        .select(
            "acl_id", "seq", "kind", F.element_at(severity, F.col("kind")).alias("severity"),
            F.when(F.col("kind") == "undetermined", F.col("unresolved_reason")).alias("unresolved_reason"),
        )
    )


def causes(entries: DataFrame, kind: str, limit: int = SHORT) -> DataFrame:
    """Every earlier entry responsible for a shadowed or redundant one, as long rows.

    This lists the answer itself: in long lists covering shapes are joined back to their entries only for the
    entries that carry the observation.
    """
    short, long = _split(active(entries), limit)

    def caused(i: Column) -> Column:
        other, same = (lambda o: _is_other(o, i)), (lambda o: _is_same(o, i))
        shadowed = lambda first: F.exists(first, lambda o: F.coalesce(other(o), F.lit(False)))
        differs = lambda o: o["action"] == i["action"] if kind == "redundant" else o["action"] != i["action"]
        marked = (lambda first: shadowed(first)) if kind == "shadowed" else (lambda first: ~shadowed(first) & F.exists(first, lambda o: F.coalesce(same(o), F.lit(False))))
        found = lambda first: F.when(marked(first), F.transform(F.filter(first, differs), lambda o: o["seq"]))
        return let(_covering(i), lambda first: F.struct(i["seq"].alias("seq"), found(first).alias("by")))

    rows = _gathered(short).select("acl_id", F.inline(F.transform("all", caused))).select("acl_id", "seq", F.explode("by").alias("cause_seq"))
    if long is None:
        return rows
    distinct = shapes(long)
    carried = _classified_long(long, distinct).where(F.col("kind") == kind).select("acl_id", "seq", "action", F.col("shape").alias("i"))
    hit = F.col("cause_action") == F.col("action") if kind == "redundant" else F.col("cause_action") != F.col("action")
    return rows.unionByName(_earlier(carried, long, distinct, hit).select("acl_id", "seq", "cause_seq"))


def _earlier(inner: DataFrame, live: DataFrame, distinct: DataFrame, hit: Column) -> DataFrame:
    pairs = shape_cover(distinct).select("acl_id", "i", "o")
    outer = with_shape(live).select("acl_id", F.col("shape").alias("o"), F.col("seq").alias("cause_seq"), F.col("action").alias("cause_action"))
    met = inner.join(pairs, ["acl_id", "i"]).drop("i")
    return met.join(outer, ["acl_id", "o"]).where((F.col("cause_seq") < F.col("seq")) & hit)


def summary(devices: DataFrame, entries: DataFrame, seen: DataFrame) -> DataFrame:
    """Per device: lists, clean lists, counts per kind, and whether nothing was analysed.

    ``devices`` rows are (device_id, acl_id or NULL).
    """
    per_list = seen.groupBy("acl_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    lists = devices.join(per_list, "acl_id", "left")
    any_obs = F.coalesce(sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0])), F.lit(0))
    return lists.groupBy("device_id").agg(
        F.count("acl_id").alias("lists"),
        F.count_if(F.col("acl_id").isNotNull() & (any_obs == 0)).alias("clean_lists"),
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in KINDS],
        (F.count("acl_id") == 0).alias("analysed_nothing"),
    )


def sequence_errors(entries: DataFrame) -> DataFrame:
    """Lists whose declared sequence numbers repeat."""
    return entries.groupBy("acl_id", "seq").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def covering_counts(entries: DataFrame, limit: int = SHORT) -> DataFrame:
    """Number of earlier entries that cover each active entry."""
    short, long = _split(entries, limit)
    counted = F.transform("all", lambda i: F.struct(i["seq"].alias("seq"), F.size(_covering(i)).cast("bigint").alias("n")))
    rows = _gathered(short).select("acl_id", F.inline(counted)).where(F.col("n") > 0).groupBy("acl_id", "seq").agg(F.sum("n").alias("covering"))
    if long is None:
        return rows
    inner = with_shape(long).select("acl_id", "seq", F.col("shape").alias("i"))
    return rows.unionByName(_earlier(inner, long, shapes(long), F.lit(True)).groupBy("acl_id", "seq").agg(F.count("*").alias("covering")))
