"""Clean readings to customer segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.operators.impute import fill_profile
from meterlens.operators.profile import build_profile, standardise_profile
from meterlens.operators.segment import davies_bouldin, fit_clusters, one_cluster, project_plane, resolve_k, silhouette
from meterlens.params import CLUSTER, KEY, SegmentParams
from meterlens.session import settle


@dataclass(frozen=True)
class Segments:
    assignments: DataFrame
    k: int
    profile: DataFrame | None = None
    scaled: DataFrame | None = None

    def quality(self) -> DataFrame | None:
        """(clientes, clusters, silueta, davies_bouldin) of the segments; the measures are NULL where there is
        one cluster, or as many as customers.
        """
        if self.scaled is None:
            return None
        columns = [c for c in self.scaled.columns if c != KEY]
        rows = settle(self.scaled.join(self.assignments, KEY).select(
            KEY, CLUSTER, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("_v")))
        counts = rows.agg(F.count(F.lit(1)).alias("clientes"), F.count_distinct(CLUSTER).alias("clusters"))
        n, clusters = counts.first()
        if not 1 < clusters < n:
            return counts.withColumns({"silueta": F.lit(None).cast("double"), "davies_bouldin": F.lit(None).cast("double")})
        # One row each.
        return counts.withColumns({"silueta": silhouette(rows, "_v", CLUSTER).scalar(),
                                   "davies_bouldin": davies_bouldin(rows, "_v", CLUSTER).scalar()})

    def plane(self) -> DataFrame | None:
        """Two-dimensional projection of the scaled profile with the cluster of each customer."""
        if self.scaled is None or len(self.scaled.columns) < 3:
            return None
        columns = [c for c in self.scaled.columns if c != KEY]
        return project_plane(self.scaled.join(self.assignments, KEY), columns)


def segment_customers(readings: DataFrame, params: SegmentParams) -> Segments:
    """Profile, fill, standardise, choose k, cluster; everyone in cluster 0 when inactive.

    The profile has one row per customer. It is written once, and every trial of k reads it.
    """
    if not params.active or not params.specs:
        return Segments(settle(one_cluster(readings)), 1)
    columns = list(params.specs)
    profile = settle(build_profile(readings, columns))
    profile = settle(fill_profile(profile, columns))
    scaled = settle(standardise_profile(profile, columns))
    fits: dict[int, DataFrame] = {}
    k = resolve_k(scaled, columns, params.k_candidates, params.method, params.fixed_k,
                  params.seed, params.knee, params.silhouette, fits)
    assigned = fits.get(k)
    if assigned is None:
        assigned = settle(fit_clusters(scaled, columns, k, params.seed))
    return Segments(assigned, k, profile, scaled)
