"""The run from raw lines to published marts: clean, star, gates, marts, documents."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens import schemas
from revlens.config import Settings
from revlens.operators.cleaning import CleanResult, clean
from revlens.operators.star import Star, build_star, star_from_tables
from revlens.plans import dashboard, gates, quality
from revlens.plans.marts import Marts
from revlens.sources import manifest, sinks
from revlens.sources.raw import PART
from revlens.sources.releases import Release, Version, open_version
from revlens.sources.stages import StageStore


@dataclass(frozen=True)
class Published:
    cleaned: CleanResult
    star: Star
    marts: Marts
    counts: dict[str, int]
    folder: str


@dataclass(frozen=True)
class Loaded:
    """A published version, for reports without a rebuild."""

    version: Version
    star: Star
    marts: Marts


# marts with exact money, next to the exports with doubles
EXACT = "exact_"


def run(
    raw: DataFrame,
    settings: Settings,
    folder: str,
    store: StageStore | None = None,
    advisory: Collection[str] = gates.ADVISORY,
    delivered: Sequence[str] = (),
    sources: Sequence[str] = (),
) -> Published:
    """Build everything from `raw` and publish it as a new version under `folder`.

    Nothing is written there before every gate has passed, and readers keep the version before until all
    tables and documents of this one are there. Gates named in `advisory` warn only. `delivered` names the
    parts that came, so that one without rows is reported; `sources` the folders whose files go into the
    manifest.
    """
    spark = raw.sparkSession
    store = store or StageStore(spark)
    cleaned = clean(raw, settings, store)
    star = build_star(cleaned.numbered, settings, store)
    marts = Marts(star, settings, store)
    gates.assert_gates(gates.gate_report(cleaned, star, marts, written=True), advisory)
    release = Release.begin(spark, folder)
    return publish(release, cleaned, star, marts, delivered, sources)


def publish(
    release: Release,
    cleaned: CleanResult,
    star: Star,
    marts: Marts,
    delivered: Sequence[str] = (),
    sources: Sequence[str] = (),
    audited: bool = True,
) -> Published:
    """Write all tables and documents of a build and commit them as the current version.

    `audited` adds the profile of the raw union, where it knows its parts.
    """
    raw, settings = cleaned.raw, cleaned.settings
    release.write("transactions", cleaned.transactions())
    release.write("quarantine", cleaned.quarantine())
    for name, frame in star.tables().items():
        release.write(name, frame)
    for name, frame in sorted(marts.tables().items()):
        release.write(name, sinks.sorted_export(frame))
        release.write(EXACT + name, _in_contract(frame, schemas.MARTS[name]))
    if audited and PART in raw.columns:
        for name, frame in audit_tables(quality.audit_view(raw, settings), settings, delivered).items():
            release.write(name, frame)
    if sources:
        release.write("source_manifest", manifest.manifest_of(raw.sparkSession, sources))
    published = Published(cleaned, star, marts, release.counts, release.folder)
    for name, text in documents(published).items():
        release.write_text(f"{name}.json", text)
    release.commit()
    return published


def _in_contract(frame: DataFrame, contract: T.StructType) -> DataFrame:
    return frame.select(*[F.col(item.name).cast(item.dataType).alias(item.name) for item in contract.fields])


def load(
    spark: SparkSession, settings: Settings, folder: str, store: StageStore | None = None, version: str | None = None
) -> Loaded:
    """The star and the marts of the current version under `folder`, or of a named one.

    Every table is held against its contract; nothing is computed again. The lines that some reports read
    come from joining the dimensions to the fact.
    """
    found = open_version(spark, folder, version)
    tables = {name: found.table(name, contract) for name, contract in schemas.STAR.items()}
    star = star_from_tables(tables, settings)
    exact = {name: found.table(EXACT + name, contract) for name, contract in schemas.MARTS.items()}
    return Loaded(found, star, Marts.from_tables(star, settings, store or StageStore(spark), exact))


def audit(loaded: Loaded) -> DataFrame:
    """The gates of the marts and the fact, over what is published as it is now.

    A run checks what it is about to publish; this finds what has changed since. It reads the fact once
    more, and raises where a table has lost or gained rows.
    """
    loaded.version.checked()
    return gates.published_gates(loaded.star, loaded.marts)


def audit_tables(audit: DataFrame, settings: Settings, delivered: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The profile of the raw union, a table each."""
    return {
        "audit_readiness": quality.readiness_figures(audit, delivered),
        "audit_column_profile": quality.column_profile(audit),
        "audit_quality_flags": quality.quality_flags(audit, settings),
        "audit_revenue_month": quality.revenue_by_month(audit),
        "audit_revenue_country": quality.revenue_by_country(audit),
        "audit_stock_codes": quality.stock_code_evidence(audit, settings),
    }


def documents(published: Published | Loaded) -> dict[str, str]:
    """The dashboard document as JSON text, and of a build the quality report."""
    found = {"dashboard": sinks.json_text(dashboard.payload(published.star, published.marts))}
    if isinstance(published, Published):
        found["dq_report"] = sinks.json_text(quality.quality_report(published.cleaned))
    return found
