"""Infer withheld authors from stored metadata and a list of withheld ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivemill.operators.flags import flag_propagation, withheld_authors, withheld_owners
from archivemill.plans.sinks import write_table
from archivemill.plans.staging import staged


def run_infer(
    metadata: DataFrame, withheld: DataFrame, folder: str, *, profiles: DataFrame | None = None, fmt: str = "parquet"
) -> None:
    """Write ``metadata_updated``, and by our own definition ``all_users`` and ``users_inferred``.

    ``all_users`` are the authors with a withheld message; ``users_inferred`` the extra
    users whose withheld message links to one that is not withheld: those whose whole profile is known to
    be withheld (``profiles``, see ``mining.withheld_profiles``) are left out.
    """
    ids = staged(withheld.select(withheld.columns[0]).distinct(), "withheld-ids")
    write_table(flag_propagation(metadata, ids), f"{folder}/metadata_updated", fmt=fmt)
    write_table(withheld_authors(metadata, ids), f"{folder}/all_users", fmt=fmt)
    inferred = withheld_owners(metadata, ids)
    if profiles is not None:
        known = profiles.select(F.col(profiles.columns[0]).cast("bigint").alias("author_id"))
        inferred = inferred.join(known, "author_id", "left_anti")
    write_table(inferred, f"{folder}/users_inferred", fmt=fmt)
