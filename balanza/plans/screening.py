"""Document screening end to end: viability, bank and ids, validity, coverage, congruence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from balanza.functions.ids import identity_alert, is_valid_account, normalize_clabe
from balanza.functions.text import null_if_sentinel
from balanza.operators import screening


def screen(docs: DataFrame, fields: DataFrame, as_of) -> dict[str, DataFrame]:
    """Frames ``accepted``, ``rejected``, ``coverage`` and ``congruence``.

    ``docs`` has job_id, doc_id, name, text and has_images; ``fields`` the outside reading per
    document: doc_id, bank, clabe, period, rfc, holder. The pattern's tax id wins over it.
    """
    scored = screening.score_documents(docs)
    rejected = scored.filter(~F.col("viable")).select("job_id", "doc_id", F.col("verdict").alias("error"))
    read = fields.select(
        "doc_id", F.lower(null_if_sentinel(F.col("bank"))).alias("_bank"), null_if_sentinel(F.col("clabe")).alias("_clabe"),
        null_if_sentinel(F.col("period")).alias("period"), F.upper(null_if_sentinel(F.col("rfc"))).alias("_rfc"), null_if_sentinel(F.col("holder")).alias("holder"),
    )
    found = screening.detect_bank(scored.filter("viable")).join(read, "doc_id", "left")
    rows = found.select(
        "job_id", "doc_id", "text", "period", "holder", F.col("_bank").alias("bank"), normalize_clabe(F.col("_clabe"), F.col("_bank")).alias("clabe"),
        F.coalesce("rfc", "_rfc").alias("rfc"),
    )
    # Validity is asked without the bank as well, so a 15-digit account also needs a valid tax id.
    valid = is_valid_account(F.col("rfc"), F.col("clabe"), F.col("bank"), F.col("text")) & is_valid_account(
        F.col("rfc"), F.col("clabe"), F.lit(None).cast("string"), F.col("text")
    )
    checked = rows.withColumn("_valid", valid)
    accepted = checked.filter("_valid").select(
        "job_id", "doc_id", "bank", "clabe", "period", "rfc", "holder", identity_alert(F.col("rfc"), F.col("holder")).alias("alert")
    )
    invalid = checked.filter(~F.col("_valid")).select(
        "job_id", "doc_id",
        F.lit("El documento parece ser un estado de cuenta, pero no se encontró una CLABE válida o el RFC es incorrecto/pertenece a un banco excluido.").alias("error"),
    )
    return {
        "accepted": accepted, "rejected": rejected.unionByName(invalid),
        "coverage": screening.period_coverage(accepted, as_of), "congruence": screening.identity_congruence(accepted),
    }
