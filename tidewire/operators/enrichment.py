"""Thin stories get their articles' sentences, within a budget of fetches; what was fetched once is remembered.

Fetching itself is somebody else's: fetched pages have landed in a table, and a story of the budget meets its page there. The budget is a number of the configuration; each task keeps its own first stories, and those meet, so
no task sorts all of them. A host's share is cut before that, within partitions first. The chosen stories are no more than the budget, so they are sent to the pages: no page is shuffled, and pages nobody asked for are
only looked at for their address.

Outcomes: unimportant, no_url, full (it tells enough by itself), non_article, domain_blocked; cached (a good entry of the cache with enough sentences), cached_<status> otherwise; budget_exhausted; ok, not_expanded (too few sentences),
no_text, not_html, paywall, network_error (no page has landed).

Defined results: a null id never meets the cache and stands last within its order; rows with one id are stories of their own, and the newest entry of the cache counts; of several pages with one address the one with the
smallest page_id counts; null titles, summaries and pages count as empty; empty tables give no rows or an unchanged cache. Other columns of stories are passed on, of pages and cache ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, hygiene, pages, summary
from ..functions import text as tx
from . import leaders

#: What marks a page that only subscribers see, and parts of an address that belong to no article.
PAYWALL_MARKERS = ("subscribe to continue", "subscribers only", "this article is for subscribers", "sign in to read")
NO_ARTICLE = ("video", "live", "login", "tag")
#: The greatest budget that is sent to all tasks.
MOST_BUDGET = 10_000
CACHE = "id long, url string, status string, sentences array<string>, fetched_at timestamp, ttl_hours int"


def useful(text: Column, headline: Column, least: int = 4) -> Column:
    """How many different sentences tell something: of `least` words, no filler, and not the headline again."""
    clean = F.transform(tx.sentences(F.coalesce(text, F.lit(""))), hygiene.clean_sentence_text)
    tell = F.filter(clean, lambda s: (F.size(tx.tokens(s)) >= least) & ~hygiene.filler(s) & ~F.coalesce(summary.paraphrases(s, headline), F.lit(False)))
    return F.size(F.array_distinct(F.transform(tell, hygiene.normalised)))


def article(html: Column, shortest: int = 40) -> Column:
    """Paragraphs of a page with `shortest` characters or more."""
    return F.filter(pages.paragraphs(F.coalesce(html, F.lit(""))), lambda p: F.length(p) >= shortest)


def article_told(html: Column) -> Column:
    """Clean sentences of a page's paragraphs, each once."""
    said = F.flatten(F.transform(article(html), tx.sentences))
    return F.array_distinct(F.filter(F.transform(said, hygiene.clean_sentence_text), lambda s: (F.size(tx.tokens(s)) >= 4) & ~hygiene.filler(s)))


def enriched(
    stories: DataFrame, landed: DataFrame, cache: DataFrame, now: Column, *order: Column, domains: DataFrame, important: Column | None = None, thin: Column | None = None, budget: int = 15, per_host: int | None = None,
    least: int = 2, most: int = 12, told: Callable[[Column], Column] = article_told, no_article: tuple[str, ...] = NO_ARTICLE, markers: tuple[str, ...] = PAYWALL_MARKERS, ttl_ok: int = 48, ttl_error: int = 24,
) -> tuple[DataFrame, DataFrame]:
    """Stories with outcome, expanded and article_sentences (their summary is those sentences then); and the cache after.

    stories: id, url, title, summary and more; order: which come first within the budget (ties: smaller id, then address); landed: page_id, url, html; cache: as CACHE, good for its hours; domains: (domain), all that may be asked,
    with their subdomains; important, thin: truth of a story, by default all, and fewer than `least` useful sentences.
    """
    if budget > MOST_BUDGET:
        raise ValueError(f"a budget of more than {MOST_BUDGET} fetches")
    now = now.cast("timestamp")
    host = tx.host(F.col("url"))
    thin = useful(F.col("summary"), F.col("title")) < least if thin is None else thin
    apart = F.arrays_overlap(F.split(F.lower(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))), "/"), F.array(*map(F.lit, no_article)))
    # a host and all it is a part of: a.b.c, b.c, c
    parts = F.split(F.coalesce(host, F.lit("")), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    marked = leaders.cut(stories.withColumn("_n", F.monotonically_increasing_id()))
    may = marked.select("_n", F.explode(above).alias("domain")).join(domains.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_semi").select("_n").distinct().withColumn("_may", F.lit(True))
    first = F.when(~F.coalesce(F.lit(True) if important is None else important, F.lit(False)), "unimportant").when(F.coalesce(F.trim("url"), F.lit("")) == "", "no_url").when(~thin, "full").when(apart, "non_article").when(F.col("_may").isNull(), "domain_blocked")
    judged = marked.join(may, "_n", "left").withColumn("_first", first).drop("_may")

    good = cache.where(F.col("id").isNotNull() & (now <= F.col("fetched_at") + F.make_dt_interval(F.lit(0), F.col("ttl_hours"))))
    good = good.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct("status", "sentences"), "fetched_at").alias("_hit"))
    judged = judged.join(good, judged["id"] == good["_id"], "left").drop("_id")
    known = F.col("_hit").isNotNull()
    enough = known & (F.col("_hit.status") == "ok") & (F.size("_hit.sentences") >= least)
    hit = F.when(enough, "cached").when(known, F.concat(F.lit("cached_"), F.col("_hit.status")))
    judged = leaders.cut(judged.withColumn("_known", F.coalesce("_first", hit)).withColumn("_kept", F.when(F.col("_first").isNull() & enough, F.col("_hit.sentences"))).drop("_first", "_hit"))

    ask = judged.where("_known is null")
    full = (*order, F.asc_nulls_last("id"), F.asc("url"), F.asc("_n"))
    if per_host is not None:
        ask = ask.withColumn("_place", F.row_number().over(Window.partitionBy(host).orderBy(*full))).where(F.col("_place") <= per_host).drop("_place")
    chosen = leaders.cut(ask.orderBy(*full).limit(budget).select("_n", "id", "url", classify.norm_url(F.col("url")).alias("_key")))
    wanted = F.broadcast(chosen.select("_key").distinct())  # no more than the budget
    page = landed.withColumn("_key", classify.norm_url(F.col("url"))).join(wanted, "_key").groupBy("_key").agg(F.min_by(F.struct(F.coalesce("html", F.lit("")).alias("html")), "page_id").alias("p"))
    got = page.withColumn("said", F.slice(told(F.col("p.html")), 1, most))
    html = F.col("p.html")
    status = F.when(~classify.looks_like_html(html), "not_html").when(classify.paywalled(html, list(markers)), "paywall").when(F.size("said") == 0, "no_text").otherwise("ok")
    got = got.select("_key", status.alias("status"), F.when(status == "ok", F.col("said")).alias("sentences"))
    fetched = leaders.cut(chosen.join(got, "_key", "left").select("_n", "id", "url", F.coalesce("status", F.lit("network_error")).alias("status"), "sentences"))

    met = judged.join(F.broadcast(fetched.select("_n", "status", F.col("sentences").alias("_said"))), "_n", "left")
    new = F.when(F.col("status").isNull(), "budget_exhausted").when((F.col("status") == "ok") & (F.size("_said") < least), "not_expanded").otherwise(F.col("status"))
    outcome = F.coalesce("_known", new)
    sentences = F.when(outcome == "cached", F.col("_kept")).when(outcome == "ok", F.col("_said"))
    own = [c for c in stories.columns if c not in ("outcome", "expanded", "article_sentences")]
    out = met.withColumn("_outcome", outcome).withColumn("_sentences", sentences)
    out = out.select(
        *(F.coalesce(F.array_join("_sentences", " "), F.col(c)).alias(c) if c == "summary" else F.col(c) for c in own), F.col("_outcome").alias("outcome"), F.col("_sentences").isNotNull().alias("expanded"), F.col("_sentences").alias("article_sentences")
    )
    entry = fetched.where("id is not null").select("id", "url", "status", "sentences", now.alias("fetched_at"), F.when(F.col("status") == "ok", ttl_ok).otherwise(ttl_error).alias("ttl_hours"))
    entry = entry.groupBy("id").agg(F.min_by(F.struct(*entry.columns[1:]), "url").alias("e")).select("id", "e.*")
    after = cache.select(*entry.columns).join(F.broadcast(entry.select("id")), "id", "left_anti").unionByName(entry)
    return out, after
