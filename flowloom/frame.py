"""EventFrame: a measurement as a DataFrame of events with metadata, gates, recipes and basins (PRJ-01 to PRJ-08).

All methods return new frames; nothing runs before an action.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.catalog import Catalog, Metadata
from flowloom.functions.numeric import NAN
from flowloom.operators import basins as B
from flowloom.operators import density, derive, gates, hierarchy, kernel_sums, sample, stats


@dataclass(frozen=True)
class EventFrame:
    df: DataFrame
    meta: Metadata = field(default_factory=Metadata)
    gating: tuple = ()
    enabled: bool = True
    limit: int = 0
    basins: tuple[B.Basin, ...] = ()
    resolver: derive.Resolver = field(default_factory=derive.Resolver)
    luts: dict = field(default_factory=dict)
    catalog: Catalog = field(default_factory=Catalog)
    excluded: DataFrame | None = None
    logs: dict[str, list[str]] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    key: str = "event_idx"
    temporary: frozenset[str] = frozenset()

    # ---- features ----------------------------------------------------------------------------------------------

    def with_features(self, *names: str) -> EventFrame:
        """The frame with these columns: stored ones, then basins', then derived ones."""
        df, derived = B.resolve_some(self.df, list(dict.fromkeys(names)), self.basins, self.key, self.run_identifier)
        for n in derived:
            if n not in df.columns:
                df = self.resolver.add(df, [n], self.meta, self.luts)
        return replace(self, df=df)

    def __contains__(self, name: str) -> bool:
        if name in self.df.columns or any(name in b.offers() for b in self.basins):
            return True
        return self.resolver.choose(name, set(self.df.columns), self.meta, self.luts) is not None

    def features(self, origin: str = "all") -> list[str]:
        """Sorted names that the catalogue knows, by where they come from (PRJ-03):

        innate     stored here, or in an internal basin
        basin      offered by basins
        ancillary  derivable and not innate; they may be in basins too
        temporary  given by with_temporary
        local      at hand without computing or asking elsewhere: columns, and internal and file basins
        loaded     local, innate, and those that one projection of stored numbers derives
        scalar     numbers among all
        all        everything
        """
        columns = sorted(c for c in self.df.columns if self.catalog.exists(c))
        offered = lambda *kinds: sorted({f for b in self.basins if not kinds or b.kind in kinds for f in b.offers() if self.catalog.exists(f)})
        if origin == "basin":
            return offered()
        if origin == "temporary":
            return sorted(self.temporary)
        if origin == "local":
            return sorted({*columns, *offered("internal", "file")})
        innate = sorted({*(c for c in columns if c not in self.temporary), *offered("internal")})
        if origin == "innate":
            return innate
        ancillary = [f for f in self.resolver.available(self.df, self.meta, self.luts) if f not in innate]
        if origin == "ancillary":
            return ancillary
        if origin == "loaded":
            return sorted({*self.features("local"), *innate, *(f for f in ancillary if f in derive.RAPID)})
        every = sorted({*columns, *innate, *offered(), *ancillary})
        return {"all": every, "scalar": [f for f in every if self.catalog.exists(f, True)]}[origin]

    def with_temporary(self, name: str, values: DataFrame) -> EventFrame:
        """A feature from a table (event_idx, value); NaN where it has no row (UDF-04, PRJ-08)."""
        side = values.select(F.col(self.key), F.col("value").alias(name))
        return replace(self, df=self.df.join(side, self.key, "left").withColumn(name, F.coalesce(name, F.lit(NAN))), temporary=self.temporary | {name})

    @property
    def run_identifier(self) -> str | None:
        """The run's own identifier, or a digest of when and where it was measured (STR-05)."""
        own = self.meta.get("experiment", "run identifier")
        if own:
            return own
        parts = [self.meta.get("experiment", "time"), self.meta.get("experiment", "date"), self.meta.get("setup", "identifier")]
        if any(p is None for p in parts):
            return None
        return re.sub(r"(.{8})(.{4})(.{4})(.{4})(.{12})", r"\1-\2-\3-\4-\5", hashlib.md5("_".join(parts).encode()).hexdigest())

    @staticmethod
    def identifiers(time: Column, date: Column, setup: Column) -> Column:
        """The same digest for a catalogue of measurements, one row each."""
        digest = F.md5(F.concat_ws("_", time.cast("string"), date.cast("string"), setup.cast("string")))
        return F.regexp_replace(digest, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")

    # ---- gates -------------------------------------------------------------------------------------------------

    def gate(self, *more) -> EventFrame:
        return replace(self, gating=(*self.gating, *more))

    def without_gates(self) -> EventFrame:
        return replace(self, gating=(), limit=0, excluded=None)

    def limited(self, n: int) -> EventFrame:
        return replace(self, limit=n)

    def exclude(self, rows: DataFrame) -> EventFrame:
        rows = rows.select(self.key)
        return replace(self, excluded=rows if self.excluded is None else self.excluded.unionByName(rows))

    @property
    def condition(self) -> Column:
        return gates.combine(self.gating, self.enabled)

    def gated(self) -> DataFrame:
        """The events that pass all gates, the manual exclusions and the limit."""
        if not self.enabled:
            return self.df
        df = self.df.where(self.condition)
        if self.excluded is not None:
            df = gates.exclude(df, self.excluded, self.key)
        return sample.take_hashed(df, self.limit, self.key)

    def child(self) -> EventFrame:
        """The gated events as a measurement of their own (SRC-27)."""
        df = hierarchy.child(self.df, self.condition if self.enabled else F.lit(True), None if self.excluded is None else self.excluded.select(F.col(self.key).alias("root_idx")))
        meta = self.meta.copy()
        meta.values.pop("filtering", None)
        return replace(self, df=df, meta=meta, gating=(), excluded=None, limit=0)

    # ---- results -----------------------------------------------------------------------------------------------

    def count(self) -> int:
        n = self.meta.get("experiment", "event count")
        return n if n is not None else self.df.count()

    def statistics(self, features: Sequence[str], methods=stats.METHODS) -> DataFrame:
        """Long form; Events, %-gated and the flow rate first, under the feature "" (AGG-01, AGG-06)."""
        have = [f for f in features if f in self]
        f = self.with_features(*have)
        inside = f.condition if self.excluded is None and not self.limit else None
        long = stats.describe(f.df if inside is not None else f.gated(), features, methods, inside)
        total = f.df.agg(*stats.event_counts(f.condition)) if inside is not None else f.gated().agg(F.count("*").alias("Events")).crossJoin(f.df.agg(F.count("*").alias("_n"))).select("Events", F.try_divide(100 * F.col("Events"), F.col("_n")).alias("%-gated"))
        flow = float(self.meta.get("setup", "flow rate", NAN))
        rows = [F.struct(F.lit("").alias("feature"), F.lit(m).alias("method"), F.col(f"`{m}`").cast("double").alias("value")) for m in ("Events", "%-gated")]
        rows.append(F.struct(F.lit("").alias("feature"), F.lit("Flow rate").alias("method"), F.lit(flow).alias("value")))
        return total.select(F.explode(F.array(*rows)).alias("s")).select("s.*").unionByName(long)

    # ---- views -------------------------------------------------------------------------------------------------

    def scatter(self, x: str, y: str, n: int = 0, scale: tuple[str, str] = ("linear", "linear"), remove_invalid: bool = True) -> DataFrame:
        """Gated events thinned to n by density (TOP-04), in their own coordinates."""
        f = self.with_features(x, y)
        return sample.thin(f.gated(), x, y, n, self.key, remove_invalid, scale).select(self.key, x, y)

    def density_exact(self, x: str, y: str, kind: str = "gauss", scale: tuple[str, str] = ("linear", "linear"), positions: DataFrame | None = None) -> DataFrame:
        """Gated events, or positions (key, x, y), with the kernel density of all gated events there (KDE-06)."""
        df = self.with_features(x, y).gated()
        return kernel_sums.density_exact(df, x, y, kind, self.key, positions, scale=scale)

    def density_scatter(self, x: str, y: str, kind: str = "histogram", scale: tuple[str, str] = ("linear", "linear"), accuracy: tuple[float | None, float | None] = (None, None)) -> DataFrame:
        """Gated events with the density where they lie (KDE-12)."""
        df = self.with_features(x, y).gated()
        return density.density_at_events(df, x, y, density.raster(df, x, y, kind, accuracy, scale), scale=scale).select(self.key, x, y, "density")

    def contour_lines(self, x: str, y: str, quantiles: Sequence[float], kind: str = "histogram", scale: tuple[str, str] = ("linear", "linear"), accuracy: tuple[float | None, float | None] = (None, None)) -> list:
        return density.contour_lines(self.with_features(x, y).gated(), x, y, quantiles, kind, accuracy, scale)

    def contour_spacing(self, x: str, y: str, quantile: float = 0.5) -> tuple[float, float]:
        return density.smooth_spacing(self.with_features(x, y).gated(), x, y, quantile)
