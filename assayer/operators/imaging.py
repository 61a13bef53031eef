"""Images as rows (id, h, w, photo of h x w bytes): each operator runs the numpy routines over Arrow batches, an image at a time.

A row whose photo is null, or of another length than h x w, gives one row with nulls. Python holds a batch of inputs
(spark.sql.execution.arrow.maxRecordsPerBatch; lower it for large photographs) and 16 results. Nothing shuffles but the ids,
before any pixel exists.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16


def seeded(*parts) -> np.random.Generator:
    """The same stream of numbers for the same parts, on any executor."""
    return np.random.default_rng(zlib.crc32(repr(parts).encode()))


def spread(ids: DataFrame, *keys: str) -> DataFrame:
    """Few small rows over all cores, since each stands for much work; AQE leaves a number that was asked for."""
    return ids.repartition(4 * ids.sparkSession.sparkContext.defaultParallelism, *keys)


def mapped(df: DataFrame, f: Callable[[dict], dict | list[dict]], schema: str) -> DataFrame:
    """f of each row; a list gives several rows."""
    names = [x.strip().split(" ")[0] for x in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for pdf in batches:
            for row in pdf.to_dict("records"):
                got = f(row)
                held += got if isinstance(got, list) else [got]
                if len(held) >= CHUNK:
                    yield _frame(held, names)
                    held = []
        if held:
            yield _frame(held, names)

    return df.mapInPandas(run, schema)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)


def _fields(schema: str) -> list[str]:
    """The top-level fields of a schema's text."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:k])
            start = k + 1
    return out + [schema[start:]]


def pixels_of(row: dict) -> np.ndarray | None:
    h, w, data = row["h"], row["w"], row["photo"]
    if data is None or h is None or w is None or pd.isna(h) or pd.isna(w) or len(data) != int(h) * int(w) or not len(data):
        return None
    return np.frombuffer(data, np.uint8).reshape(int(h), int(w)).astype(float)


def packed(image: np.ndarray) -> dict:
    return {"h": image.shape[0], "w": image.shape[1], "photo": np.clip(np.round(image), 0, 255).astype(np.uint8).tobytes()}


def _plain(x):
    """numpy's scalars as Python's, NaN as null, at any depth."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, np.ndarray):
        return _plain(x.tolist())
    x = x.item() if isinstance(x, np.generic) else x
    return None if isinstance(x, float) and not np.isfinite(x) else x


def per_photo(photos: DataFrame, f: Callable[[np.ndarray, dict], dict | list[dict]], schema: str, keep: str = "") -> DataFrame:
    """f of each image and its row, beside the id and the columns to keep; a bad image leaves all else null."""
    kept = [x.strip().split(" ")[0] for x in _fields(keep) if x.strip()]

    def one(row: dict):
        image = pixels_of(row)
        got = {} if image is None else f(image, row)
        return [_plain({"id": row["id"]} | {k: row[k] for k in kept} | g) for g in (got if isinstance(got, list) else [got])]

    return mapped(photos, one, f"id long, {keep + ', ' if keep else ''}{schema}")


def captures(ids: DataFrame, side: int = 160) -> DataFrame:
    """(id, severity) to photographs of invented films with the truth of each: blur, veil's share and corners."""
    from assayer.imaging import film

    def one(row: dict) -> dict:
        rng = seeded(int(row["id"]), float(row["severity"]))
        shot, truth = film.photograph(film.chest(side, rng), film.Capture.drawn(row["severity"], rng), rng)
        return _plain({"id": row["id"], "severity": row["severity"], "true_blur": truth.blur, "true_veil": truth.veil_fraction, "true_quad": truth.quad.ravel()}) | packed(shot)

    schema = "id long, severity double, h int, w int, photo binary, true_blur double, true_veil double, true_quad array<double>"
    return mapped(spread(ids.select("id", "severity"), "id"), one, schema)


def degraded_photos(photos: DataFrame, severity: float, names: list[str] | None = None) -> DataFrame:
    """Photographs gone bad: what was done at which severity, and its mean over all ways there are; 0 leaves them as they are."""
    from assayer.imaging import degrade

    if unknown := sorted(set(names or ()) - set(degrade.DEGRADATIONS)):
        raise ValueError(f"unknown degradations {unknown}")

    def one(image, row):
        out, record = degrade.degraded(image, severity, seeded(int(row["id"]), severity), names)
        return packed(out) | {"ops": record, "total_severity": degrade.total_severity(record)}

    return per_photo(photos, one, "h int, w int, photo binary, ops map<string, double>, total_severity double")


def photo_features(photos: DataFrame) -> DataFrame:
    from assayer.imaging import pixels

    names = "mean std p05 p95 entropy laplacian_var height width aspect".split()
    return per_photo(photos, lambda image, _: pixels.features(image), ", ".join(f"{n} double" for n in names))


def photo_hashes(photos: DataFrame, side: int = 16) -> DataFrame:
    """The difference hash as words of 64 bits, for exclusive or and bit_count on the JVM."""
    from assayer.imaging import pixels

    return per_photo(photos, lambda image, _: {"hash": np.frombuffer(pixels.difference_hash(image, side).tobytes(), ">i8")}, "hash array<bigint>")


def rehosted_distance(photos: DataFrame) -> DataFrame:
    """Bits of the hash that change when another archive holds the same image: what a threshold must allow for."""
    from assayer.imaging import degrade, pixels

    def one(image, _):
        a, b = pixels.difference_hash(image), pixels.difference_hash(degrade.rebundled(image, 256))
        return {"bits": int(np.unpackbits(a ^ b).sum())}

    return per_photo(photos, one, "bits int")


def fiducial_rows(photos: DataFrame) -> DataFrame:
    from assayer.imaging import inverse

    def one(image, _):
        f = inverse.fiducials(image / 255)
        return {"coverage": f.coverage, "stop_source": f.stop_source, "stop_share": f.stop.mean(), "has_marker": f.has_marker, "marker_confidence": f.marker_confidence,
                "edges": len(f.edges), "usable_edges": sum(e.usable for e in f.edges), "quad": None if f.quad is None else f.quad.ravel()}

    return per_photo(photos, one, "coverage string, stop_source string, stop_share double, has_marker boolean, marker_confidence double, edges int, usable_edges int, quad array<double>")


def recovery_rows(photos: DataFrame, keep: str = "") -> DataFrame:
    """What the inversion found: tone, blur, veil and where it is, scale, densities of the lungs and their errors."""
    from assayer.imaging import inverse, pixels

    def one(image, _):
        r = inverse.recover(image)
        lungs, spot = r.within(r.region), inverse.hotspot(r.veil.map)
        middle = lambda a: pixels.median(a) if a.size else None
        return {"coverage": r.fiducials.coverage, "tone": r.tone.method, "gamma": r.tone.gamma, "gamma_sigma": r.tone.gamma_sigma, "blur": r.blur.method, "sigma": r.blur.sigma,
                "sigma_error": r.blur.sigma_error, "veil": r.veil.method, "veil_share": middle(lungs.veil.map / lungs.signal), "veil_sigma": r.veil.sigma, "hotspot": spot["direction"],
                "px_per_mm": r.px_per_mm, "density": middle(lungs.density), "sigma_random": middle(lungs.sigma_random), "sigma_systematic": r.sigma_systematic}

    return per_photo(photos, one, "coverage string, tone string, gamma double, gamma_sigma double, blur string, sigma double, sigma_error double, veil string, veil_share double, "
                     "veil_sigma double, hotspot string, px_per_mm double, density double, sigma_random double, sigma_systematic double", keep)  # fmt: skip


def certificates(photos: DataFrame) -> DataFrame:
    """The verdict on each photograph, nested by finding."""
    from assayer.imaging import inverse

    finding = "key string, delta_d double, floor_median double, floor_p90 double, margin_db double, verdict string, insufficient_area double, limiting string, shares map<string, double>"
    fields = ", ".join(x.strip().replace(" ", ": ", 1) for x in _fields(finding))
    return per_photo(photos, lambda image, _: inverse.certify(inverse.recover(image)),
                     f"coverage string, abstained boolean, reason string, verdict string, worst string, margin_db double, limiting string, findings array<struct<{fields}>>")


def channel_rows(photos: DataFrame) -> DataFrame:
    """One row a photograph and core finding: bits, what took them, and the share of an ideal capture's."""
    from assayer.imaging import findings, inverse

    names = "bits_per_cell n_cells total_bits bits_ideal delivered_fraction lost_veil lost_blur lost_quantization lost_sensor_noise".split()

    def one(image, _):
        r = inverse.recover(image)
        return [{"finding": f.key} | (inverse.channel(r, f) or {}) for f in findings.core()]

    return per_photo(photos, one, "finding string, " + ", ".join(f"{n} double" for n in names))


def aid_rows(ids: DataFrame, width: int = 224, height: int = 40) -> DataFrame:
    """(id, severity) to a photographed wedge and ruler: steps read, gamma with its error, scale against the truth."""
    from assayer.imaging import film, inverse, pixels, targets

    def one(row: dict) -> dict:
        rng = seeded("aids", int(row["id"]), float(row["severity"]))
        c, scale = film.Capture.drawn(row["severity"], rng), rng.uniform(0.6, 1.2)
        light = pixels.blur(film.transmittance(targets.aids_strip(width, height, scale)), min(c.psf_sigma, 2.0))
        v = c.tone(rng.poisson(light * c.full_well) / c.full_well)
        steps = targets.read_wedge(v)
        tone = inverse.tone_fit([(float(film.transmittance(d)), x, e) for d, x, e in steps])
        return _plain({"id": row["id"], "severity": row["severity"], "steps": len(steps), "tone": tone.method, "gamma": tone.gamma, "gamma_sigma": tone.gamma_sigma, "true_gamma": c.gamma,
                       "px_per_mm": targets.read_ruler(v), "true_px_per_mm": scale})

    return mapped(spread(ids.select("id", "severity"), "id"), one, "id long, severity double, steps int, tone string, gamma double, gamma_sigma double, true_gamma double, px_per_mm double, true_px_per_mm double")


def sheet_scores(ids: DataFrame, side: int = 256) -> DataFrame:
    """(id, severity) to a photographed test sheet's score, discs nested."""
    from assayer.imaging import film, targets

    s = targets.sheet(side)

    def one(row: dict) -> dict:
        rng = seeded("sheet", int(row["id"]), float(row["severity"]))
        shot, truth = film.photograph(s.film, film.Capture.drawn(row["severity"], rng), rng)
        return _plain({"id": row["id"], "severity": row["severity"], "true_blur": truth.blur} | targets.score(shot, s))

    disc = "patch: string, delta_d: double, size_mm: double, dprime: double, seen: boolean, floor: double, predicted: boolean"
    schema = f"id long, severity double, true_blur double, ok boolean, coverage string, bias double, rmse double, slope double, wedge_rmse double, sigma double, edge_sigma double, px_per_mm double, discs array<struct<{disc}>>"
    return mapped(spread(ids.select("id", "severity"), "id"), one, schema)


def sheet_readings(ids: DataFrame, side: int = 256) -> DataFrame:
    """(id, severity) to (id, region, density): each flat of a photographed sheet, read by the sheet's own wedge."""
    from assayer.imaging import film, inverse, targets

    s = targets.sheet(side)

    def one(row: dict) -> list[dict]:
        rng = seeded("sheet", int(row["id"]), float(row["severity"]))
        shot, _ = film.photograph(s.film, film.Capture.drawn(row["severity"], rng), rng)
        flat = targets.rectified(shot / 255, inverse.fiducials(shot / 255).quad, s)
        if flat is None:
            return []
        value, d = targets.transfer(flat, s)
        return [_plain({"id": row["id"], "region": r.key, "density": float(np.interp(np.median(r.core(flat)), value, d))}) for r in s.of("flat")]

    return mapped(spread(ids.select("id", "severity"), "id"), one, "id long, region string, density double")


def finding_dimension(spark) -> DataFrame:
    from assayer.imaging.findings import FINDINGS

    return spark.createDataFrame([(f.key, f.name, f.delta_d, f.delta_d_sigma, f.size_mm, f.size_sigma_mm) for f in FINDINGS], "key string, name string, delta_d double, delta_d_sigma double, size_mm double, size_sigma_mm double")


def disc_confusion(scores: DataFrame, clear_db: float = 3.0, rose: float = 5.0) -> DataFrame:
    """Predicted against seen over all discs, and violations: predicted with a clear margin, yet barely or not seen (d' at most 0.7 of Rose's)."""
    d = scores.select("id", F.inline("discs"))
    clear = F.col("predicted") & (20 * F.log10(F.col("delta_d") / F.col("floor")) >= clear_db) & (F.col("dprime") <= 0.7 * rose)
    both = lambda p, s: F.count_if((F.col("predicted") == p) & (F.col("seen") == s))
    return d.agg(both(True, True).alias("tp"), both(True, False).alias("fp"), both(False, True).alias("fn"), both(False, False).alias("tn"), F.count_if(clear).alias("violations"), F.count("*").alias("n"))
