"""Convolution and Fourier queries on frames of user values and on spike waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import arrays as A
from tidewright.functions import signal
from tidewright.plans.information import r6, r6_of
from tidewright.plans.rates import FRAME, FRAMES_SQL, exploded, user_frames
from tidewright.session import read_table

KERNEL = (0.5, 0.25, 0.125, 0.0625)
FS = 30_000.0


def kernel():
    return F.array(*[F.lit(v) for v in KERNEL])


def waveforms(spark, sf):
    """Rows (spike_id, x): every sound waveform once."""
    w = read_table(spark, sf, "spike_waveforms").where(A.sound("waveforms", 91) & F.col("spike_id").isNotNull())
    return w.select("spike_id", F.col("waveforms").alias("x")).dropDuplicates(["spike_id"])


WAVE_SQL = """wv AS (SELECT DISTINCT spike_id, waveforms AS x FROM spike_waveforms
 WHERE len(waveforms) = 91 AND list_count(waveforms) = 91 AND NOT list_contains(waveforms, 'nan'::double) AND spike_id IS NOT NULL)"""


def circ_conv(spark, sf):
    return exploded(user_frames(spark, sf), A.circular_convolution("x", kernel()))


def circ_conv_fft(spark, sf):
    return exploded(user_frames(spark, sf), signal.circular_convolution_fft(F.col("x"), kernel()))


def circulant_apply(spark, sf):
    """Each frame times the circulant matrix of the kernel: row i of the matrix is the kernel moved by i."""
    return exploded(user_frames(spark, sf), A.circular_convolution(A.padded(kernel(), F.size("x")), "x"))


def circshift(spark, sf):
    return exploded(user_frames(spark, sf), A.circshift("x", 3))


def linear_conv(spark, sf):
    return exploded(user_frames(spark, sf), A.linear_convolution("x", kernel()))


def deconv(spark, sf):
    """Frames convolved and divided again by the kernel: the frames themselves."""
    return exploded(user_frames(spark, sf).withColumn("x", A.linear_convolution("x", kernel())), A.deconvolution("x", kernel()))


def _spectrum(frames, c):
    return frames.select("user_id", "frame", F.posexplode(c).alias("k", "z")).select("user_id", "frame", "k", r6_of(F.col("z.re"), "re"), r6_of(F.col("z.im"), "im"))


def dft(spark, sf):
    return _spectrum(user_frames(spark, sf), A.dft("x"))


def fft(spark, sf):
    return _spectrum(user_frames(spark, sf), signal.fft(F.col("x")))


def idft(spark, sf):
    return exploded(user_frames(spark, sf).withColumn("z", signal.fft(F.col("x"))), A.inverse_dft("z"))


def phase_shift(spark, sf):
    """Spectrum of the frames moved by 3: that of the frames, turned by 2 pi 3 k / n."""
    return _spectrum(user_frames(spark, sf), signal.fft(A.circshift("x", 3)))


def freq_filter(spark, sf):
    return exploded(user_frames(spark, sf).withColumn("z", signal.fft(F.col("x"))), A.inverse_dft(A.band_filter("z", 0.0, 0.125)))


def wave_magnitude(spark, sf):
    """Magnitudes of every waveform's spectrum up to half the sampling rate."""
    w = waveforms(spark, sf).select("spike_id", F.posexplode(F.slice(A.magnitude(signal.fft(F.col("x"))), 1, 46)).alias("k", "m"))
    return w.select("spike_id", "k", r6("m"))


def spectrogram(spark, sf):
    w = waveforms(spark, sf).select("spike_id", F.posexplode(signal.spectrogram(F.col("x"), 32, 24, 64)).alias("frame", "s"))
    return w.select("spike_id", "frame", F.array_max("s").alias("peak"), (F.array_position("s", F.array_max("s")) - 1).alias("bin"))


def lowpass(spark, sf):
    w = waveforms(spark, sf).select("spike_id", signal.lowpass(F.col("x"), 3000.0, FS).alias("x"))
    return w.select("spike_id", F.posexplode("x").alias("p", "v"))


QUERIES = {f.__name__: f for f in (circ_conv, circ_conv_fft, circulant_apply, circshift, linear_conv, deconv, dft, fft, idft, phase_shift, freq_filter, wave_magnitude, spectrogram, lowpass)}
WHOLE = ("circ_conv", "circ_conv_fft", "circulant_apply", "circshift", "linear_conv", "deconv", "dft", "fft", "idft", "phase_shift", "freq_filter")
QUERIES |= {f"{name}_whole": QUERIES[name] for name in WHOLE}  # earlier names of the same
KER_SQL = f"kn AS (SELECT unnest({list(KERNEL)}) AS h, unnest(range({len(KERNEL)})) AS j)"
CIRC = f"WITH {FRAMES_SQL}, {KER_SQL} SELECT user_id, frame, cast((fr.p + j) % greatest(n, {len(KERNEL)}) AS int) AS p, round(sum(v * h), 6) + 0.0 AS v FROM fr, kn GROUP BY ALL"
ANGLE = "2 * pi() * ((p * k) % n) / n"
BINS = f"(SELECT unnest(range({FRAME})) AS {{0}}) WHERE {{0}} < n"
DFT_SQL = f"""{FRAMES_SQL}, sp AS (SELECT user_id, frame, n, cast(k AS int) AS k, sum(v * cos({ANGLE})) AS re, -sum(v * sin({ANGLE})) AS im FROM fr, {BINS.format("k")} GROUP BY ALL)"""
PLAIN = f"WITH {FRAMES_SQL} SELECT user_id, frame, p, round(v, 6) + 0.0 AS v FROM fr"
SPEC = "SELECT user_id, frame, k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM sp"
TURN = "2 * pi() * ((3 * k) % n) / n"
ORACLES = {
    "circ_conv": CIRC,
    "circ_conv_fft": CIRC,
    "circulant_apply": CIRC,
    "circshift": f"WITH {FRAMES_SQL} SELECT user_id, frame, cast((p + 3) % n AS int) AS p, round(v, 6) + 0.0 AS v FROM fr",
    "linear_conv": f"WITH {FRAMES_SQL}, {KER_SQL} SELECT user_id, frame, cast(fr.p + j AS int) AS p, round(sum(v * h), 6) + 0.0 AS v FROM fr, kn GROUP BY ALL",
    "deconv": PLAIN,
    "idft": PLAIN,
    "dft": f"WITH {DFT_SQL} {SPEC}",
    "fft": f"WITH {DFT_SQL} {SPEC}",
    "phase_shift": f"WITH {DFT_SQL} SELECT user_id, frame, k, round(re * cos({TURN}) + im * sin({TURN}), 6) + 0.0 AS re, round(im * cos({TURN}) - re * sin({TURN}), 6) + 0.0 AS im FROM sp",
    "freq_filter": f"WITH {DFT_SQL}, ok AS (SELECT * FROM sp WHERE least(k, n - k) / n <= 0.125) SELECT user_id, frame, cast(p AS int) AS p, round(sum(re * cos({ANGLE}) - im * sin({ANGLE})) / n, 6) + 0.0 AS v FROM ok, {BINS.format('p')} GROUP BY user_id, frame, n, p",
    "wave_magnitude": f"WITH {WAVE_SQL}, e AS (SELECT spike_id, cast(p AS int) AS p, x[p + 1] AS v FROM wv, (SELECT unnest(range(91)) AS p)), s AS (SELECT spike_id, cast(k AS int) AS k, sum(v * cos(2 * pi() * ((p * k) % 91) / 91)) AS re, sum(v * sin(2 * pi() * ((p * k) % 91) / 91)) AS im FROM e, (SELECT unnest(range(46)) AS k) GROUP BY ALL) SELECT spike_id, k, round(sqrt(re * re + im * im), 6) + 0.0 AS m FROM s",
}
ORACLES |= {f"{name}_whole": ORACLES[name] for name in WHOLE}
