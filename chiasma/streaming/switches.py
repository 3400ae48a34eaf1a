"""Streaming forms of the marker queries: windowed counts with a watermark, and a switch counter with state per cell and
chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chiasma.operators import genotype as G


def windowed_counts(markers: DataFrame, ts: str = "ts", window: str = "1 day", slide: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """(start, chrom, n, alt_fraction) over sliding windows of event time; ts may be without time zone."""
    m = G.informative(markers.withColumn("_t", F.col(ts).cast("timestamp"))).withWatermark("_t", late)
    g = m.groupBy(F.window("_t", window, slide).alias("w"), "chrom").agg(F.count("*").alias("n"), F.avg(G.alt_fraction()).alias("alt_fraction"))
    return g.select(F.col("w.start").alias("start"), "chrom", "n", "alt_fraction")


def running_switches(markers: DataFrame, ref_low: float = 0.2, alt_high: float = 0.8) -> DataFrame:
    """(barcode, chrom, markers, switches) so far, after each batch, for the cells it touched. State is three numbers; the
    markers of a cell and chromosome have to arrive in order of pos, within a batch in any order."""
    g = G.informative(markers).select("barcode", "chrom", "pos", G.tri_state(G.alt_fraction(), ref_low, alt_high).alias("g"))
    kind = g.schema["barcode"].dataType.simpleString()

    def step(key, frames, state):
        import pandas as pd

        n, switches, last = state.get if state.exists else (0, 0, -1.0)
        rows = pd.concat(list(frames)).sort_values("pos")
        for value in rows["g"]:
            switches += last >= 0 and value != last
            n, last = n + 1, float(value)
        state.update((int(n), int(switches), float(last)))
        yield pd.DataFrame({"barcode": [key[0]], "chrom": [key[1]], "markers": [n], "switches": [switches]})

    return g.groupBy("barcode", "chrom").applyInPandasWithState(step, f"barcode {kind}, chrom string, markers long, switches long", "n long, switches long, last double", "update", "NoTimeout")
