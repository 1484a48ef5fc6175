"""Compiling contexts: evidence for many tasks at once, each under a budget that its own receipt counts in.

Phases, each a DataFrame over all tasks: sources find candidates and are joined in order under a cap; candidates are
classified, ranked, rid of equal bodies, held to a quota and put in fair turns; the first of them are packed in order
while the bundle, a canonical JSON text that holds its own size twice, stays under the ceiling; a ledger says of
every candidate what became of it and why; bundle and receipt are named by digests of what they say.  A bundle's size
with its size in it is the least fixed point of size = rest + digits of the size, found for each task and item.

``persist`` keeps receipts, bundles and the versions of documents that were read; ``replay`` compiles again from just
these versions and compares digests.

Tasks: query_id, task.  Candidates: query_id, evidence_id, doc_id, version_id, source, source_order, representation,
coverage, occurrences, relevance (millionths), current, trust_zone, sensitivity, body_id, item_size.  Evidence (for
the bundles): evidence_id, item (canonical JSON).

Defined results: tasks with null id are left out, a null task is empty; a task without candidates has a bundle
without items that names what is missing; a candidate found twice counts at its first source; the rest is a refusal
("duplicate"); a bundle whose frame alone passes the ceiling is refused as a whole, with a status in place of ids;
the ledger's draft columns measure what was written, refused or not.
"""

from __future__ import annotations

from functools import partial, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import discard
from ..sources.scratch import staged as written
from . import selection as S

#: Tables here are wide and many: what made them goes at once.
staged = partial(written, clean=True)

# Limits that results must agree on.
DISCOVERED, EVALUATED, DECISIONS = 10_000, 512, 12_000
ROUNDS = 8
# End of fixed values.

#: Selected rows that are broadcast to the evidence; beyond, the join shuffles.
BROADCAST_TAKEN = 200_000

MISSING = "required_evidence_unavailable"
CUT = '{"code":"discovery_truncated","message":"Not all candidates were looked at."}'
NONE_RELEVANT = '{"code":"no_relevant_evidence","message":"No candidate is relevant enough."}'


class Limits(NamedTuple):
    budget: int
    discovered: int = DISCOVERED
    evaluated: int = EVALUATED
    decisions: int = DECISIONS

    @property
    def reserve(self) -> int:
        return -(-self.budget // 10)

    @property
    def ceiling(self) -> int:
        return self.budget - self.reserve


class Policy(NamedTuple):
    zones: tuple[str, ...] = ("inside",)
    most_sensitive: str = "confidential"
    floor: int = S.RELEVANCE_FLOOR
    required: tuple[str, ...] = ("chat", "text")


class Compiled(NamedTuple):
    """ledger: a row a task; decisions: a row a candidate; bundles: query_id, bundle (text)."""

    ledger: DataFrame
    decisions: DataFrame
    bundles: DataFrame


def settled(rest: int) -> int:
    """The size of a text that holds its own size twice; ``rest`` is its size with a 0 in both places."""
    size = 0
    for _ in range(ROUNDS):
        again = rest + 2 * (len(str(size)) - 1)
        if again == size:
            return size
        size = again
    raise ValueError("the size of the bundle does not settle")


def settled_column(rest: Column) -> Column:
    """``settled`` as a column: sizes only grow from round to round, so the rounds can be taken one after another."""
    return reduce(lambda size, _: rest + 2 * (F.length(size.cast("string")) - 1), range(4), rest)


def member(name: str, value: Column) -> Column:
    """``"name":value`` of an object in canonical JSON."""
    text = F.to_json(F.struct(value.alias(name)))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def item_json(doc_id: Column, evidence_id: Column, version_id: Column, representation: Column, body: Column) -> Column:
    """An item of a bundle: names in order, no space between."""
    content = F.concat(F.lit('{"content":{'), member("body", body), F.lit(',"media_type":"text/plain"},'))
    rest = [member("document", doc_id), member("evidence_id", evidence_id), F.lit('"reason":"lexical_match"'), member("representation", representation), member("version", version_id)]
    return F.concat(content, F.concat_ws(",", *rest), F.lit("}"))


def trace_json(evidence_id: Column, place: Column) -> Column:
    return F.concat(F.lit("{"), member("evidence_id", evidence_id), F.lit(',"final_order":'), place.cast("string"), F.lit(',"reason_code":"lexical_match"}'))


def frame(limits: Limits, used: Column, items: Column, missing: Column, task: Column, trace: Column, snapshot: str, warnings: Column) -> Column:
    """The bundle around its parts."""
    budget = F.concat(F.lit('{"budget":{"actual_used":'), used, F.lit(f',"ceiling":{limits.ceiling},"estimated_used":'), used, F.lit(f',"limit":{limits.budget},"unit":"bytes"}},"items":['))
    return F.concat(budget, items, F.lit('],"missing_evidence":['), missing, F.lit("],"), member("query", task), F.lit(',"selection_trace":['), trace, F.lit(f'],"snapshot":"{snapshot}","warnings":['), warnings, F.lit("]}"))


def lexical(units: DataFrame, terms: DataFrame, keys: list[str], most: int = 100_000) -> DataFrame:
    """query_id, keys, coverage, occurrences, relevance of the units that hold an item of a task.

    units: keys, words (array).  terms: query_id, item.  Units that hold none go before anything is shuffled."""
    n = terms.limit(most + 1).count()
    each = units.select(*keys, F.explode("words").alias("item"))
    met = each.join(F.broadcast(terms) if n <= most else terms, "item")
    wanted = terms.groupBy("query_id").agg(F.count_distinct("item").alias("wanted"))
    found = met.groupBy("query_id", *keys).agg(F.size(F.collect_set("item")).cast("long").alias("coverage"), F.count("*").alias("occurrences"))
    return found.join(wanted, "query_id").withColumn("relevance", F.expr("coverage * 1000000 div wanted")).drop("wanted")


def discovered(sources: list[DataFrame], limit: int) -> DataFrame:
    """Candidates of all sources, in their order; ``cut`` says of those beyond the cap that they are."""
    both = reduce(DataFrame.unionByName, [s.withColumn("source_order", F.lit(i)) for i, s in enumerate(sources)])
    at = F.row_number().over(W.partitionBy("query_id").orderBy("source_order", F.desc("coverage"), F.desc("occurrences"), F.col("doc_id").cast("string"), "evidence_id"))
    return both.withColumn("__at", at).where(F.col("__at") <= limit + 1).withColumn("cut", F.col("__at") > limit).drop("__at")


def allocated(candidates: DataFrame, policy: Policy) -> DataFrame:
    """Candidates with reason (null: to be packed, at ``place``)."""
    judged = S.classify(candidates.withColumn("ordinal", F.col("evidence_id")), list(policy.zones), policy.most_sensitive, policy.floor)
    judged = staged(judged.drop("ordinal", "current", "trust_zone", "sensitivity"), "compile-classified")
    ranks = {"high_value": F.lit(False), "tier": F.col("source_order"), "semantic": F.lit(None).cast("long"), "matched_weight": F.col("coverage"), "matched_signals": F.col("coverage"), "representation_id": F.col("representation")}
    chosen = S.allocate(judged.where("reason is null").drop("reason").withColumns(ranks)).drop(*ranks)
    refused = judged.where("reason is not null").withColumns({"rank": F.lit(None).cast("long"), "place": F.lit(None).cast("long")})
    both = chosen.withColumn("reason", F.when(F.col("reason") != "selected", F.col("reason"))).unionByName(refused.select(*chosen.columns))
    out = staged(both.drop("source", "coverage", "occurrences", "relevance", "body_id"), "compile-allocated")
    discard(judged)
    return out


PACKED = "query_id long, evidence_id string, final_order long, cost long, rest long"


def packed(ordered: DataFrame, ceiling: int) -> DataFrame:
    """query_id, evidence_id, final_order (null: does not fit), cost, rest (size of the bundle with zeros, after it).

    ordered: query_id, evidence_id, place, item_size, trace_size (with order 0), rest (of the frame alone).  A task has
    at most Limits.evaluated rows."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        rest = t["rest"][0].as_py()
        used, n, out = settled(rest), 0, []
        for evidence, item, trace in zip(t["evidence_id"].to_pylist(), t["item_size"].to_pylist(), t["trace_size"].to_pylist(), strict=True):
            tried = rest + item + trace + len(str(n)) - 1 + (2 if n else 0)
            cost = settled(tried) - used
            fits = used + cost <= ceiling
            if fits:
                rest, used, n = tried, used + cost, n + 1
            out.append((evidence, n - 1 if fits else None, cost, rest))
        columns = list(zip(*out, strict=True))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([t["query_id"].combine_chunks(), *(pa.array(c, x) for c, x in zip(columns, types, strict=True))], names=["query_id", "evidence_id", "final_order", "cost", "rest"])

    return ordered.groupBy("query_id").applyInArrow(pack, PACKED)


def compile_contexts(tasks: DataFrame, sources: list[DataFrame], evidence: DataFrame, snapshot: str, limits: Limits, policy: Policy = Policy()) -> Compiled:
    """All phases; see the module."""
    none = F.lit("")
    tasks = staged(tasks.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("task", F.lit("")).alias("task")), "compile-tasks")
    empty = frame(limits, F.lit("0"), none, none, F.col("task"), none, snapshot, none)
    bases = tasks.select("query_id", F.octet_length(empty).cast("long").alias("base_rest"))
    found = staged(discovered(sources, limits.discovered), "compile-discovered")
    cut = found.where("cut").select("query_id").distinct().withColumn("over", F.lit(True))
    cut = staged(cut, "compile-cut")
    judged = allocated(found.where("not cut").drop("cut"), policy)
    discard(found)
    within = F.col("place") <= limits.evaluated
    sizes = judged.where(within).select("query_id", "evidence_id", "place", "item_size", F.octet_length(trace_json(F.col("evidence_id"), F.lit(0))).cast("long").alias("trace_size"))
    fits = bases.where(settled_column(F.col("base_rest")) <= limits.ceiling).withColumnRenamed("base_rest", "rest")
    taken = staged(packed(sizes.join(fits, "query_id"), limits.ceiling), "compile-packed")

    outcome = F.when(F.col("reason") == "stale", "stale").when(F.col("reason").isNotNull(), "rejected").when(~within, "truncated").when(F.col("final_order").isNotNull(), "selected").when(F.col("cost").isNotNull(), "omitted").otherwise("refused")
    why = F.coalesce("reason", F.when(~within, "evaluation_limit").when(F.col("final_order").isNotNull(), "lexical_match").when(F.col("cost").isNotNull(), "budget").otherwise("base_bundle_exceeds_budget"))
    told = judged.join(taken.select("query_id", "evidence_id", "final_order", "cost", F.lit(True).alias("packed")), ["query_id", "evidence_id"], "left")
    told = told.withColumns({"packed": F.coalesce("packed", F.lit(False)) & F.col("reason").isNull(), "__order": F.col("final_order"), "__cost": F.col("cost")})
    told = told.withColumns({"final_order": F.when(F.col("packed"), F.col("__order")), "cost": F.when(F.col("packed"), F.col("__cost"))})
    decisions = staged(told.select("query_id", "evidence_id", "doc_id", "version_id", "representation", "source_order", outcome.alias("outcome"), why.alias("reason"), "final_order", F.coalesce("cost", "item_size").alias("cost"), "rank", "place"), "compile-decisions")
    discard(judged)

    n = lambda kind: F.count_if(F.col("outcome") == kind).alias(f"n_{kind}")
    line = F.concat_ws("|", F.lpad(F.coalesce(F.col("place"), F.lit(10**9)).cast("string"), 10, "0"), "evidence_id", F.col("source_order").cast("string"), "outcome", "reason", F.coalesce(F.col("final_order").cast("string"), F.lit("-")), F.col("cost").cast("string"))
    summed = decisions.groupBy("query_id").agg(*map(n, ("selected", "omitted", "rejected", "stale", "truncated", "refused")), F.count("*").alias("n_decisions"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("decided"), (F.count_if(F.col("reason") != "relevance") == 0).alias("only_relevance"))
    last = taken.groupBy("query_id").agg(F.max("rest").alias("rest"))
    rows = bases.join(summed, "query_id", "left").join(last, "query_id", "left").join(cut, "query_id", "left")
    zero = {f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)) for k in ("selected", "omitted", "rejected", "stale", "truncated", "refused", "decisions")}
    rows = rows.withColumns(zero).withColumns({"over": F.coalesce("over", F.lit(False)) | (F.col("n_truncated") > 0), "abstains": F.coalesce("only_relevance", F.lit(False)), "decided": F.coalesce("decided", F.lit(""))})
    lack = F.when(F.col("n_selected") > 0, none).otherwise(F.lit(",".join(f'{{"evidence_type":"{r}","reason_code":"{MISSING}"}}' for r in sorted(policy.required))))
    warn = F.concat_ws(",", F.when(F.col("over"), F.lit(CUT)), F.when(F.col("abstains"), F.lit(NONE_RELEVANT)))
    rows = rows.withColumns({"missing": lack, "warnings": warn, "base_used": settled_column(F.col("base_rest"))})
    rows = rows.withColumn("used", settled_column(F.coalesce("rest", "base_rest") + F.octet_length("missing") + F.octet_length("warnings")))
    status = F.when(F.col("base_used") > limits.ceiling, "base_bundle_exceeds_budget").when(F.col("used") > limits.ceiling, "bundle_exceeds_budget").when(F.col("n_decisions") > limits.decisions, "max_decisions_exceeded").otherwise("compiled")
    rows = staged(rows.withColumn("status", status), "compile-rows")

    taken_rows = decisions.where("outcome = 'selected'").select("query_id", "evidence_id", "final_order")
    few = taken_rows.limit(BROADCAST_TAKEN + 1).count() <= BROADCAST_TAKEN  # then the texts stay where they are read
    picked = evidence.select("evidence_id", "item").join(F.broadcast(taken_rows) if few else taken_rows, "evidence_id")
    parts = picked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_order", "item", trace_json(F.col("evidence_id"), F.col("final_order")).alias("trace")))).alias("parts"))
    whole = rows.join(tasks, "query_id").join(parts, "query_id", "left")
    each = lambda name: F.coalesce(F.array_join(F.transform("parts", lambda x: x[name]), ","), none)
    text = frame(limits, F.col("used").cast("string"), each("item"), F.col("missing"), F.col("task"), each("trace"), snapshot, F.col("warnings"))
    drafts = staged(whole.select("query_id", "status", text.alias("bundle")), "compile-bundles")
    named = rows.join(drafts.select("query_id", F.octet_length("bundle").cast("long").alias("draft_bytes"), F.sha2("bundle", 256).alias("draft_id")), "query_id").join(tasks.select("query_id", F.sha2("task", 256).alias("task_digest")), "query_id")
    done = lambda c: F.when(F.col("status") == "compiled", c)
    facts = F.concat_ws("|", F.lit(f"{limits}|{policy}|{snapshot}"), "task_digest", "draft_id", "decided", F.col("base_used").cast("string"), F.col("used").cast("string"))
    ledger = named.select("query_id", "status", "base_used", done(F.col("used") - F.col("base_used")).alias("incremental"), done(F.col("used")).alias("used"), done(limits.ceiling - F.col("used")).alias("remaining"), *zero, F.col("over").alias("truncated"), "abstains", done(F.col("draft_bytes")).alias("bundle_bytes"), "task_digest", done(F.col("draft_id")).alias("bundle_id"), done(F.sha2(facts, 256)).alias("receipt_id"), F.col("used").alias("draft_used"), "draft_bytes", "draft_id")
    return Compiled(staged(ledger, "compile-ledger"), decisions, drafts.where("status = 'compiled'").select("query_id", "bundle"))


def snapshot_digest(scopes: DataFrame) -> str:
    """Digest of (doc_id, version_id) rows, whatever their order: sums of their hashes."""
    h = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "version_id"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(2)]
    r = scopes.agg(F.count("*").alias("n"), *parts).first()
    return f"{r['n']}-{r['s0'] or 0}-{r['s1'] or 0}"


def persist(compiled: Compiled, scopes: DataFrame, snapshot: str, root: str) -> None:
    """Receipts, bundles and the versions that they were made from, each table whole under the snapshot's digest."""
    for frame_, name in ((compiled.ledger, "receipts"), (compiled.bundles, "bundles"), (compiled.decisions, "decisions"), (scopes.select("doc_id", "version_id"), "scopes")):
        frame_.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/snapshot={snapshot}")


def replayed(receipts: DataFrame, again: Compiled) -> DataFrame:
    """query_id, outcome of comparing kept receipts with a compilation of the same snapshot."""
    new = again.ledger.select("query_id", *(F.col(c).alias(f"new_{c}") for c in ("status", "task_digest", "bundle_id", "receipt_id")))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"new_{c}"))
    outcome = F.when(F.col("new_status").isNull(), "task_missing").when(~same("task_digest"), "task_mismatch").when(~same("bundle_id"), "replay_bundle_diverged").when(~same("receipt_id") | ~same("status"), "replay_receipt_diverged").otherwise("equal")
    return receipts.join(new, "query_id", "left").select("query_id", outcome.alias("outcome"))


def pinned(versions: DataFrame, scopes: DataFrame) -> tuple[DataFrame, int]:
    """Of all ``versions`` (doc_id, version_id, ...) those that a snapshot names, and how many of its scopes are gone."""
    found = versions.join(scopes.select("doc_id", "version_id"), ["doc_id", "version_id"], "left_semi")
    return found, scopes.join(versions, ["doc_id", "version_id"], "left_anti").count()
