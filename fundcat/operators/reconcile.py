"""What happens to listed programs when their pages are read again.

Pages are decided in the order of the inventory, and a decision may take a program away
from those that follow. Two pages depend on each other only if one of them may change a
program that the other asks about; so in each round all pages go ahead that no earlier
undecided page can touch, and the outcome is that of going through them one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundcat.functions import exprs as X
from fundcat.functions import roles as P
from fundcat.operators.evidence import NUMBERED, SUPPORTING_ROLES, publisher_identity
from fundcat.schema import AS_OF
from fundcat.tables import kept

#: Roles of pages that are no program of their own.
NO_PROGRAM = ("directory", "announcement", "supporting", "guidelines", "faq", "application")
_NEW = "new-"
_DECIDED = "item_id string, outcome string, program string, other string, association string, round int"


def _path(url) -> Column:
    return F.regexp_replace(X.path_of(url), "/+$", "")


def _place(url) -> Column:
    """Programs and pages of different places never meet. A publisher that numbers its
    programs in the query is one place."""
    host = X.host_of(url)
    return F.when(host == NUMBERED[0][0], host).otherwise(F.concat_ws("|", host, _path(url)))


def _programs(programs: DataFrame) -> DataFrame:
    url = F.col("source_url")
    below = F.when(_path(url) != "", F.concat(F.lit("below "), X.host_of(url), F.lit("|"), _path(url)))
    return programs.select(
        "id", "name", "source_url", "fresh", "verified", F.struct((~F.col("verified")).alias("later"), "created_at", "id").alias("rank"), _place(url).alias("place"), publisher_identity(url).alias("identity"),
        F.array_compact(F.array(F.concat(F.lit("is "), publisher_identity(url)), below)).alias("keys"), (F.col("verified") | (F.col("origin") != "crawler") | F.coalesce(F.col("method") == "official-structured-data", F.lit(False))).alias("lasting"), (F.col("publication_state") == "published").alias("published"), (F.col("publication_state") == "hidden").alias("hidden"),
    )


def _pages(items: DataFrame, g: DataFrame, aliases: DataFrame) -> DataFrame:
    """Items with all that does not change: role, own program, and where to look."""
    url = F.col("page_url")
    own = g.select(F.col("id").alias("opportunity_id"), F.col("name").alias("g_name"), F.col("source_url").alias("g_url"), F.col("rank").alias("g_rank"), F.col("place").alias("g_place"), F.col("identity").alias("g_identity"), F.col("lasting").alias("g_lasting"), F.col("verified").alias("g_verified"))
    known = aliases.select("opportunity_id", F.col("url").alias("page_url"), F.lit(True).alias("alias")).distinct()
    rows = items.select("*", X.once(P.page_role(F.col("title"), url, F.col("body"))).alias("role"), publisher_identity(url).alias("identity"), X.host_of(url).alias("host"), _path(url).alias("path"))
    rows = rows.join(own, "opportunity_id", "left").join(known, ["opportunity_id", "page_url"], "left")
    adds = F.col("role").isin(*SUPPORTING_ROLES)
    below = adds & (X.host_of("g_url") == F.col("host")) & (_path("g_url") != "") & F.startswith("path", F.concat(_path("g_url"), F.lit("/")))
    stays = F.col("g_rank").isNotNull() & (F.col("candidate_id").isNull() | (F.col("identity") == F.col("g_identity")) | below | F.coalesce("alias", F.lit(False)))
    mine = lambda c: F.when(stays, F.col(c))
    steps = F.split("path", "/")
    parents = F.when(adds & (F.size(steps) > 2), F.transform(F.sequence(F.lit(2), F.size(steps) - 1), lambda n: F.concat_ws("|", F.col("host"), F.array_join(F.slice(steps, 1, n), "/")))).otherwise(F.array().cast("array<string>"))
    at_once = F.when(F.col("host") == NUMBERED[0][0], F.array("host")).otherwise(parents)
    same_place = (X.host_of("item_url") == F.col("host")) & (X.path_of("item_url") == X.path_of("page_url")) & (F.regexp_extract("item_url", r"(\?[^#]*)", 1) == F.regexp_extract("page_url", r"(\?[^#]*)", 1))
    return rows.select(
        F.col("item_id").cast("string").alias("item_id"), "ord", "role", "page_url", F.col("candidate_id").isNotNull().alias("candidate"), (~same_place & (publisher_identity(F.col("item_url")) != F.col("identity"))).alias("moved"),
        mine("opportunity_id").alias("own"), mine("g_rank").alias("own_rank"), mine("g_place").alias("own_place"), F.coalesce(mine("g_lasting"), F.lit(False)).alias("lasting"), F.coalesce(mine("g_verified"), F.lit(False)).alias("verified"), F.coalesce(F.when(stays, P.program_name(F.col("g_name"), F.col("g_url"), F.col("body"))), F.lit(False)).alias("named"),
        F.concat(F.array(F.concat(F.lit("is "), F.col("identity"))), F.transform(parents, lambda p: F.concat(F.lit("below "), p))).alias("keys"), _place(url).alias("place"), F.array_distinct(F.array_compact(F.concat(F.array(_place(url), mine("g_place")), at_once))).alias("places"),
    )


def reconcile_decide(items: DataFrame, programs: DataFrame, aliases: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """``items(item_id, ord, opportunity_id, candidate_id, item_url, page_url, title,
    body)``, pages that were read, in the order of ``ord``, no two alike; ``programs(id,
    name, source_url, verified, created_at, origin, method, publication_state, fresh)``,
    those not merged, ``fresh`` if their page was read within a day; ``aliases
    (opportunity_id, url)`` -> ``(item_id, outcome, program, other, association, round)``.

    Outcomes: identity-review (a redirect to another program), merged (``other`` goes into
    ``program``: of a pair the verified or older one stays), duplicate-review, attached,
    source-review, hidden, excluded, published (a new program, which later pages may
    belong to), kept, ambiguous. Items without a program have none; an empty inventory has
    no decisions. Rounds end when all are decided: as many as the longest chain of pages
    that may change each other's programs."""
    live = kept(_programs(programs).select("id", "rank", "place", "keys", "fresh", "published", "hidden"), "reconcile-programs")
    todo = kept(_pages(items, _programs(programs), aliases), "reconcile-pages")
    moved = todo.where("moved").select("item_id", F.lit("identity-review").alias("outcome"), F.lit(None).cast("string").alias("program"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("association"), F.lit(0).alias("round"))
    done, todo, n = [moved], todo.where("not moved"), 0
    while not todo.isEmpty():
        n += 1
        decided = kept(_round(todo, live, as_of).withColumn("round", F.lit(n)), "reconcile-round")
        done.append(decided.select("item_id", "outcome", "program", "other", "association", "round"))
        gone = decided.where("outcome = 'merged'").select(F.col("other").alias("id"))
        hid = decided.where("outcome = 'hidden'").select(F.col("program").alias("id"), F.lit(True).alias("_hid")).distinct()
        new = decided.where("outcome = 'published'").select(
            F.col("program").alias("id"), F.struct(F.lit(True).alias("later"), X.now(as_of).alias("created_at"), F.col("program").alias("id")).alias("rank"), F.col("page_place").alias("place"),
            F.array_compact(F.array(F.concat(F.lit("is "), publisher_identity(F.col("page_url"))), F.when(_path("page_url") != "", F.concat(F.lit("below "), X.host_of("page_url"), F.lit("|"), _path("page_url"))))).alias("keys"),
            F.lit(True).alias("fresh"), F.lit(True).alias("published"), F.lit(False).alias("hidden"),
        )
        live = live.join(gone, "id", "left_anti").join(hid, "id", "left")
        live = live.select("id", "rank", "place", "keys", "fresh", (F.col("published") & F.col("_hid").isNull()).alias("published"), (F.col("hidden") | F.col("_hid").isNotNull()).alias("hidden"))
        todo = kept(todo.join(decided.select("item_id"), "item_id", "left_anti"), "reconcile-pages")
        live = kept(_within_reach(live.unionByName(new), todo), "reconcile-programs")
    return reduce(DataFrame.unionByName, done)


def _within_reach(live: DataFrame, todo: DataFrame) -> DataFrame:
    """Programs that an undecided page may still ask about: its own, those under its keys and
    those of its places. Others meet no page again, so rounds shrink with the pages left."""
    signs = lambda sign, words: F.transform(words, lambda w: F.concat(F.lit(sign), w))
    own = lambda c: F.array_compact(F.array(F.concat(F.lit("own "), F.col(c))))
    asked = todo.select(F.explode(F.concat(own("own"), signs("key ", F.col("keys")), signs("at ", F.col("places")))).alias("sign")).distinct()
    signed = live.select("id", F.explode(F.concat(own("id"), signs("key ", F.col("keys")), signs("at ", F.array_compact(F.array("place"))))).alias("sign"))
    return live.join(signed.join(asked, "sign", "left_semi").select("id"), "id", "left_semi")


def _round(todo: DataFrame, live: DataFrame, as_of: str) -> DataFrame:
    """Decisions on the items that no earlier one can touch."""
    shown = live.where("published")
    # A page has no need of more than two programs under a key: the best but its own.
    order = Window.partitionBy("key").orderBy("rank")
    best = shown.select(F.explode("keys").alias("key"), "id", "rank", "fresh").withColumn("at", F.row_number().over(order)).where(F.col("at") <= 2)
    met = todo.select("item_id", "own", F.explode(F.array_distinct("keys")).alias("key")).join(best, "key").where(F.col("own").isNull() | (F.col("own") != F.col("id")))
    how = F.when(F.startswith("key", F.lit("is ")), "explicit-program-identifier").otherwise("official-program-subpage")
    target = met.groupBy("item_id").agg(F.min(F.struct("rank", how.alias("how"), "id", "fresh")).alias("t"))
    alive = live.select(F.col("id").alias("own"), F.col("hidden").alias("own_hidden"), F.col("published").alias("own_shown"), F.lit(True).alias("has_own"))
    rows = todo.join(target, "item_id", "left").join(alive, "own", "left").withColumn("has_own", F.coalesce("has_own", F.lit(False)))

    # What an item may change: its own program, ones that this is preferred to, new ones.
    aside = F.col("role").isin(*NO_PROGRAM)
    touched = rows.select("item_id", "ord", "has_own", "own", "own_rank", "own_place", "own_shown", "place", "candidate", "role", (aside & ~F.col("lasting") & ~F.col("named")).alias("may_hide"), F.explode("places").alias("at"))
    others = shown.groupBy(F.col("place").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("worst"))
    fresh = F.col("candidate") & (F.col("role") == "program")
    coming = todo.where(fresh).groupBy(F.col("place").alias("at")).agg(F.min("ord").alias("next"))
    asked = touched.join(others, "at", "left").join(coming, "at", "left")
    newer = F.coalesce(F.col("next") < F.col("ord"), F.lit(False))
    mine = F.when((F.col("at") == F.col("own_place")) & F.coalesce("own_shown", F.lit(False)), 1).otherwise(0)
    beside = newer | (F.coalesce("n", F.lit(0)) > mine)
    may = lambda where, at: asked.where(where).select("item_id", "ord", F.col(at).alias("at"))
    writes = may(F.col("has_own") & (beside | F.col("may_hide")), "own_place").unionByName(may(F.col("has_own") & (newer | (F.col("worst") > F.col("own_rank"))), "at")).unionByName(may(fresh, "place")).distinct()
    touches = touched.select("item_id", "ord", "at")
    first_write = writes.groupBy("at").agg(F.min("ord").alias("first"))
    first_touch = touches.groupBy("at").agg(F.min("ord").alias("first"))
    waits = touches.join(first_write, "at").where("first < ord").select("item_id").unionByName(writes.join(first_touch, "at").where("first < ord").select("item_id"))
    rows = rows.join(waits.distinct(), "item_id", "left_anti")

    has, hidden, t = F.col("has_own"), F.coalesce("own_hidden", F.lit(False)), F.col("t.id")
    stronger = has & (F.col("own_rank") < F.col("t.rank")) & ((F.col("role") == "program") | F.col("verified") | F.col("named"))
    new = F.concat(F.lit(_NEW), F.col("item_id"))
    said = lambda outcome, program=None, other=None, how=None: F.struct(F.lit(outcome).alias("outcome"), *[(F.lit(None).cast("string") if x is None else x).alias(k) for k, x in (("program", program), ("other", other), ("association", how))])
    own = F.col("own")
    decision = (
        F.when(t.isNotNull() & stronger & F.col("t.fresh"), said("merged", own, t, F.col("t.how")))
        .when(t.isNotNull() & stronger, said("duplicate-review", own, t, F.col("t.how")))
        .when(t.isNotNull() & has & ~hidden, said("merged", t, own, F.col("t.how")))
        .when(t.isNotNull(), said("attached", t, None, F.col("t.how")))
        .when(aside & has & (F.col("lasting") | F.col("named")), said("source-review", own, None, F.lit("catalog-source-context-unresolved")))
        .when(aside & has & F.col("own_shown"), said("hidden", own))
        .when(aside, said("excluded"))
        .when(~has & fresh, said("published", new, None, F.lit("program-page")))
        .when(~has, said("ambiguous"))
        .otherwise(said("kept", own, None, F.lit("program-page")))
    )
    return rows.select("item_id", "page_url", F.col("place").alias("page_place"), X.once(decision).alias("d")).select("item_id", "page_url", "page_place", "d.*")
