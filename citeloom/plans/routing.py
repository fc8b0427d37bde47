"""Routing audit of messages: phrase groups, scores, structure, first rule that fits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.functions import text as tx
from citeloom.session import spread

MODES = ("DESTRUCTIVE_COMMAND_LOCK", "AMBIGUITY_MODE", "VENT_MODE", "SYSTEM_COMMAND_MODE", "EVIDENCE_AUDIT_MODE", "TASK_MODE")
MODE_NOTES = {
    "DESTRUCTIVE_COMMAND_LOCK": "Blocked: destructive wording with no verified target.",
    "AMBIGUITY_MODE": "Not executable: name the target.",
    "VENT_MODE": "No command found.",
    "EVIDENCE_AUDIT_MODE": "Name the claim or source to audit.",
    "SYSTEM_COMMAND_MODE": "System command recognised; audit only.",
    "TASK_MODE": "Task recognised; audit only.",
}


def phrases_present(lowered: Column, phrases) -> Column:
    """Phrases of a group that occur: multi-word ones as a substring, single words between
    characters that are no letter, digit, underscore or apostrophe. Most words are in no text, which a search without pattern
    settles first."""
    def found(p: str) -> Column:
        if " " in p:
            return lowered.contains(p)
        return lowered.contains(p) & lowered.rlike(rf"(?<![\p{{L}}\p{{N}}_']){re.escape(p)}(?![\p{{L}}\p{{N}}_'])")
    return F.array_compact(F.array(*[F.when(found(p), F.lit(p)) for p in phrases]))


def ratio(n: Column, divisor: int) -> Column:
    return tx.round_to(F.least(F.lit(1.0), n / F.lit(divisor)), 4)


def route_messages(messages: DataFrame, text: str = "text", groups: dict | None = None) -> DataFrame:
    """Adds groups, scores, structure flags, mode and rule to each message; row-local."""
    groups = groups or fv.ROUTING_GROUPS
    rows = spread(messages).withColumn("_low", F.lower(text))
    rows = rows.select(*messages.columns, *[phrases_present(F.col("_low"), p).alias(g) for g, p in groups.items()])
    n = lambda g: F.size(g)
    rows = (rows.withColumn("anger", ratio(n("affect"), 3)).withColumn("urgency_score", ratio(n("urgency"), 2))
            .withColumn("confusion_score", ratio(n("confusion"), 2)).withColumn("care_score", ratio(n("care_priority"), 2))
            .withColumn("threat_score", ratio(n("threat"), 1)).withColumn("mutation_risk", ratio(n("mutation"), 2))
            .withColumn("destructive_intent", F.greatest("threat_score", "mutation_risk"))
            .withColumn("target_specificity", F.greatest(F.lit(0.0), F.least(F.lit(1.0),
                        ratio(n("target"), 2) - 0.35 * ratio(n("ambiguity"), 2))))
            .withColumn("proof_burden", F.greatest("anger", "urgency_score", "confusion_score", "threat_score", "mutation_risk",
                                                   ratio(n("evidence"), 2))))
    rows = (rows.withColumn("destructive_command", (n("mutation") > 0) | (F.col("destructive_intent") >= 0.5))
            .withColumn("target_is_ambiguous", (n("ambiguity") > 0) & (F.col("target_specificity") < 0.75)))
    command, specific = n("command") > 0, F.col("target_specificity") >= 0.35
    high_affect = F.greatest("anger", "threat_score", "confusion_score") > 0
    rule = (F.when(F.col("destructive_command") & high_affect, F.lit("RULE_01_DESTRUCTIVE_HIGH_AFFECT"))
            .when((F.col("urgency_score") > 0) & command & ~specific, F.lit("RULE_02_URGENCY_MISSING_TARGET"))
            .when((F.col("anger") > 0) & ~command, F.lit("RULE_03_VENT_NO_COMMAND"))
            .when((F.col("care_score") > 0) & command & specific & ~F.col("destructive_command"),
                  F.lit("RULE_04_CARE_VALID_SYSTEM_COMMAND"))
            .when(n("evidence") > 0, F.lit("RULE_05_EVIDENCE_REQUEST"))
            .when(command & specific & (F.col("mutation_risk") == 0), F.lit("RULE_06_CLEAR_TASK"))
            .when(command, F.lit("RULE_02_URGENCY_MISSING_TARGET")).otherwise(F.lit("RULE_03_VENT_NO_COMMAND")))
    rows = rows.withColumn("rule", rule)
    by_rule = dict(zip(("RULE_01", "RULE_02", "RULE_03", "RULE_04", "RULE_05", "RULE_06"), MODES))
    mode = F.element_at(F.create_map(*[F.lit(x) for kv in by_rule.items() for x in kv]), F.substring("rule", 1, 7))
    notes = F.create_map(*[F.lit(x) for kv in MODE_NOTES.items() for x in kv])
    audit_id = F.concat(F.lit("AUDIT-"), F.substring(F.sha1(F.col(text).cast("binary")), 1, 16))
    return (rows.withColumn("mode", mode).withColumn("note", F.element_at(notes, F.col("mode")))
            .withColumn("action_state", F.lit("AUDIT_ONLY")).withColumn("audit_id", audit_id))
