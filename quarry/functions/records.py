"""Projections of dialogue, claim and edge records: labels from tables, judgements bounded by what was asked, texts joined from parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import bounded, compact, deduped

# The calibration bucket of a question type; those marked with a star are told apart by modality. What else starts with thread_ is a thread review.
BUCKETS = {
    "macro_main_question": "macro*", "main": "macro*", "challenge_question": "challenge*", "thread_challenge_question": "challenge*",
    "hallucination_followup": "hallucination_repair", "detail_followup": "detail_repair", "review_followup": "thread_review",
}
# The statuses of a package and what older names stand for.
STATUSES = {"unreviewed": "unreviewed", "valid": "valid", "revise": "revise", "remove": "remove", "revised": "revise", "removed": "remove"}
# Attributions of claims that can be verified, and the markers that end a paper's short name, the first that occurs.
VERIFIABLE = ("paper_claim", "paper_inference", "dialogue_reference")
NAME_MARKERS = (" - 2025 - ", " - 2024 - ", " - ")
# The states of a judged macro question.
MACRO_STATES = ("COMPLETE", "INCOMPLETE", "HALLUCINATION")


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def calibration_bucket(question_type: Column, multimodal: Column, n_events: Column) -> Column:
    """The bucket that a turn is sampled from for calibration, or null."""
    kind = F.coalesce(question_type, F.lit(""))
    found = F.coalesce(_looked_up(BUCKETS, kind), F.when(kind.startswith("thread_"), "thread_review"), F.when(n_events > 0, "hallucination_event"))
    return F.regexp_replace(found, r"\*$", F.when(multimodal, F.lit("_mm")).otherwise(F.lit("_text")))


def package_status(value: Column) -> Column:
    """One of the known statuses; a blank is unreviewed, an unknown one null, which strict callers reject."""
    given = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return _looked_up(STATUSES, F.when(given == "", "unreviewed").otherwise(given))


def verifiable(attribution: Column) -> Column:
    return F.coalesce(attribution.isin(*VERIFIABLE), F.lit(False))


def turn_summary(turn: Column, multimodal: Column, text: Column) -> Column:
    """What a list of turns shows of one: names, state, numbers of ids and events, and the question cut to 160 characters."""
    judged = turn["judge_result"]
    size = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))
    return F.struct(
        turn["turn_id"].alias("turn_id"), turn["question_id"].alias("question_id"), turn["question_type"].alias("question_type"), turn["macro_id"].alias("macro_id"), turn["challenge_type"].alias("challenge_type"),
        multimodal.alias("requires_multimodal_input"), judged["state"].alias("state"), size(judged["covered_kc_ids"]).alias("covered"), size(judged["missing_kc_ids"]).alias("missing"),
        judged["challenge_result"]["failed"].alias("challenge_failed"), size(judged["hallucination_events"]).alias("hallucination_events"), compact(text, 160).alias("question_text"),
    )


def macro_judgement(expected: Column, matched: Column, unmatched: Column, state: Column, n_events: Column) -> Column:
    """(state, matched, unmatched): ids bounded by those expected; events make it a hallucination, nothing missing makes it complete."""
    covered, named = bounded(matched, expected), bounded(unmatched, expected)
    missing = F.when(F.size(named) > 0, named).otherwise(F.array_except(expected, covered))
    given = F.upper(F.trim(F.coalesce(state, F.lit(""))))
    found = F.when(n_events > 0, "HALLUCINATION").when((F.size(missing) == 0) & (F.size(covered) > 0), "COMPLETE").when(given.isin(*MACRO_STATES), given).otherwise("INCOMPLETE")
    return F.struct(found.alias("state"), covered.alias("matched"), missing.alias("unmatched"))


def challenge_judgement(failed: Column, resisted: Column, incomplete: Column, state: Column, n_events: Column, challenge_type: Column) -> Column:
    """(state, failed, resisted, incomplete, event_type): flags as given, else by the state; a failure without events is an event of the challenge's type."""
    flags = [F.coalesce(x, F.lit(False)) for x in (failed, resisted, incomplete)]
    given, none = F.upper(F.trim(F.coalesce(state, F.lit("")))), ~(flags[0] | flags[1] | flags[2])
    lost, held = (F.when(none, given == name).otherwise(flag) for name, flag in (("CHALLENGE_FAIL", flags[0]), ("CHALLENGE_RESISTED", flags[1])))
    open_ = F.when(none, ~given.isin("CHALLENGE_FAIL", "CHALLENGE_RESISTED")).otherwise(flags[2])
    return F.struct(
        F.when(lost, "CHALLENGE_FAIL").when(held, "CHALLENGE_RESISTED").otherwise("INCOMPLETE").alias("state"), lost.alias("failed"), held.alias("resisted"), open_.alias("incomplete"),
        F.when(lost & (n_events == 0), F.coalesce(F.nullif(challenge_type, F.lit("")), F.lit("challenge_failure"))).alias("event_type"),
    )


def forbidden_claims(claims: Column, owner: Column, most: int = 4) -> Column:
    """(claim_id, claim) of the first claims given, blank ones left out; ids are those of the places in the list."""
    rows = F.transform(F.slice(claims, 1, most), lambda c, i: F.struct(F.concat_ws("_", F.lit("FC"), owner, (i + 1).cast("string")).alias("claim_id"), F.trim(c).alias("claim")))
    return F.filter(rows, lambda x: x["claim"] != "")


def reversed_relation(source: Column, target: Column, relation: Column) -> Column:
    """The claim that an edge without forbidden claims gets: its relation the other way round. The sentence is a fixed value."""
    return F.format_string("The relation between %s and %s is the reverse of %s.", source, target, F.coalesce(relation, F.lit("relates_to")))


def joined_parts(*parts: Column, more: Column | None = None) -> Column:
    """Different non-empty texts in order, one a line: what a component is embedded by."""
    given = F.array(*parts)
    return F.array_join(deduped(given if more is None else F.concat(given, F.coalesce(more, F.array().cast("array<string>")))), "\n")


def evidence_text(asset_id: Column, asset_type: Column, caption: Column, summary: Column, basis: Column, claim: Column) -> Column:
    """What an asset says for a claim, in four labelled lines. The labels are fixed values."""
    v = lambda x: F.coalesce(x, F.lit(""))
    lines = [F.concat(F.lit("Asset "), v(asset_id), F.lit(" ("), v(asset_type), F.lit("): "), v(caption)), *[F.concat(F.lit(f"{name}: "), v(x)) for name, x in (("Asset summary", summary), ("Evidence basis", basis), ("Supported claim", claim))]]
    return F.array_join(F.array(*[F.trim(x) for x in lines]), "\n")


def short_paper_name(paper_id: Column, most: int = 36) -> Column:
    """A paper's name before the first marker it has, cut and trimmed."""
    name = F.replace(paper_id, F.lit("_"), F.lit(" "))
    cut = F.coalesce(*[F.when(F.contains(name, F.lit(m)), F.substring_index(name, m, 1)) for m in NAME_MARKERS], name)
    return F.trim(F.substring(cut, 1, most))
