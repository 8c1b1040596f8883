"""Queries over windows of series: filters, spectral estimates, intervals between beats (survey B6, B8, B9, C2, C7, D1, D2, D7, G12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import estimators as E
from ..operators import filters
from .bindings import RGB, SIGNAL, rgb, signal
from .registry import query, r4

#: Samples of a window and of its step (the reference's buffer holds 300), and the frames a second that suppliers' rows stand for.
SIZE, HOP, FPS = 300, 150, 10.0

#: Windows of green as lists, as estimators.windows() makes them.
_WINS = f"""{RGB}, starts AS (SELECT session, unnest(range(0, max(seq), {HOP})) AS start FROM rgb GROUP BY session),
wins AS (SELECT s.session, s.start // {HOP} AS w, list(g ORDER BY seq) AS x, count(*) AS n FROM starts s JOIN rgb r ON r.session = s.session AND seq > start AND seq <= start + {SIZE} GROUP BY ALL HAVING count(*) = {SIZE} OR w = 0)"""


def _green(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rgb(spark, sf_dir).select("session", F.col("seq").cast("bigint").alias("seq"), F.col("g").alias("x"))
    return E.windows(s, SIZE, HOP)


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.windows(rgb(spark, sf_dir), SIZE, HOP, ("r", "g", "b"))


def _magnitudes(rows: str, out: str) -> str:
    """SQL: from `rows` (key columns, x list, n) their Hann spectra as `out` (key columns, n, m list from bin 0)."""
    return f"""{out}_p AS (SELECT * EXCLUDE x, unnest(x) * CASE WHEN n > 1 THEN 0.5 - 0.5 * cos(2 * pi() * unnest(range(n)) / (n - 1)) ELSE 1 END AS v, unnest(range(n)) AS i FROM {rows}),
{out}_b AS (SELECT {out}_p.* EXCLUDE (v, i), k, sqrt(sum(v * cos(2 * pi() * (k * i % n) / n)) ** 2 + sum(v * sin(2 * pi() * (k * i % n) / n)) ** 2) AS m FROM {out}_p, range(0, {SIZE // 2 + 1}) r(k) WHERE k <= n // 2 GROUP BY ALL),
{out} AS (SELECT * EXCLUDE (k, m), list(m ORDER BY k) AS m FROM {out}_b GROUP BY ALL)"""


def _picked(spectra: str, out: str, step: str, before: str = "NULL::DOUBLE") -> str:
    """SQL of estimators.one_peak(): `out` is `spectra` with hz instead of m."""
    hz, bpm = f"(e.k * {step})", f"(60 * e.k * {step})"
    first = "list_filter(rest, lambda e: {})[1]"
    return f"""{out}_0 AS (SELECT *, {before} AS past, list_sort(list_transform(list_filter(range(1, len(m) - 1), lambda k: m[k + 1] > m[k] AND m[k + 1] > m[k + 2]), lambda k: {{'p': -m[k + 1], 'k': -k}})) AS tops FROM {spectra}),
{out}_1 AS (SELECT * EXCLUDE tops, list_filter(list_transform(list_reduce(tops, lambda a, e: CASE WHEN len(list_filter(a, lambda o: abs(o.k - e.k) < 3)) = 0 THEN list_append(a, e) ELSE a END, []::STRUCT(p DOUBLE, k BIGINT)[]), lambda e: {{'p': -e.p, 'k': -e.k}}), lambda e: {hz} BETWEEN {E.BAND[0]} AND {E.BAND[1]})[1:5] AS tops FROM {out}_0),
{out}_2 AS (SELECT * EXCLUDE tops, list_sort(list_transform(tops, lambda e: {{'s': -e.p * CASE WHEN {bpm} BETWEEN 45 AND 130 THEN 1.0 ELSE 0.1 END * CASE WHEN past > 0 THEN CASE WHEN abs({bpm} - 2 * past) < 5 THEN 0.2 ELSE 1.0 END * (0.4 + 0.6 * exp(-(({bpm} - past) ** 2) / 450)) * CASE WHEN abs({bpm} - past) > 25 THEN 0.2 ELSE 1.0 END ELSE 1.0 END, 'p': e.p, 'bpm': {bpm}, 'hz': {hz}}})) AS c FROM {out}_1),
{out}_3 AS (SELECT *, c[2:] AS rest, CASE WHEN past > 0 AND len(c) > 1 AND c[2].p > 0.85 * c[1].p AND abs(c[2].bpm - past) < abs(c[1].bpm - past) - 5 THEN c[2] ELSE c[1] END AS b1 FROM {out}_2),
{out}_4 AS (SELECT *, CASE WHEN past > 0 AND b1.bpm > 110 AND abs(b1.bpm - 2 * past) < 10 THEN coalesce({first.format('abs(e.bpm - past) < 10')}, b1) WHEN past > 0 AND b1.bpm < 75 AND abs(b1.bpm - past / 2) < 8 THEN coalesce({first.format('abs(e.bpm - past) < 12')}, b1) ELSE b1 END AS b2 FROM {out}_3),
{out}_5 AS (SELECT *, CASE WHEN b2.bpm > 110 THEN coalesce({first.format('abs(e.bpm - b2.bpm / 2) < 8 AND e.p > 0.12 * b2.p')}, b2) ELSE b2 END AS b3 FROM {out}_4),
{out} AS (SELECT * EXCLUDE (m, c, rest, b1, b2, b3, past), CASE WHEN len(c) = 0 THEN list_sort(list_transform(list_filter(range(len(m)), lambda k: k * {step} BETWEEN {E.BAND[0]} AND {E.BAND[1]}), lambda k: {{'p': -m[k + 1], 'hz': k * {step}}}))[1].hz
  WHEN b3.bpm BETWEEN 50 AND 180 THEN b3.hz ELSE coalesce({first.format('e.bpm BETWEEN 50 AND 180')}.hz, 0) END AS hz FROM {out}_5)"""


@query()
def b6_independent_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_window(_channels(spark, sf_dir), lambda r, g, b: [{"y": y.tolist()} for y in E.independent(r, g, b)], "y array<double>", ("r", "g", "b"))


@query()
def b8_arbitrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.arbitrated(_channels(spark, sf_dir), FPS)


@query()
def b9_classical_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.classical(_channels(spark, sf_dir), FPS)


def _sections_sql() -> str:
    """The cascade of C2 as nested selects: v is a sample, s0, t0, s1, ... the state."""
    inner = "SELECT p.session, p.seq, p.x AS v0, k.* EXCLUDE (session, seq, y) FROM k JOIN p ON p.session = k.session AND p.seq = k.seq + 1"
    for i, (b, a) in enumerate(filters.butterworth(4, 0.833, 3.0, 30.0)):
        inner = f"SELECT * EXCLUDE (s{i}, t{i}), {b[1]} * v{i} - {a[1]} * v{i + 1} + t{i} AS s{i}, {b[2]} * v{i} - {a[2]} * v{i + 1} AS t{i} FROM (SELECT *, {b[0]} * v{i} + s{i} AS v{i + 1} FROM ({inner}))"
    return inner


_STATE = [f"{x}{i}" for i in range(4) for x in "st"]


@query(f"""WITH RECURSIVE {SIGNAL}, p AS (SELECT session, seq, x::DOUBLE AS x FROM signal), k AS (SELECT DISTINCT session, 0::BIGINT AS seq, {", ".join(f"0::DOUBLE AS {c}" for c in _STATE)}, 0::DOUBLE AS y FROM p
UNION ALL SELECT session, seq, {", ".join(_STATE)}, v4 FROM ({_sections_sql()})) SELECT session, seq, {r4("y")} AS y FROM k WHERE seq > 0""")
def c2_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of a session taken as 30 a second."""
    s = signal(spark, sf_dir).withColumn("seq", F.col("seq").cast("bigint"))
    return filters.bandpass(s, 30.0).withColumn("y", rounded(F.col("y")))


@query()
def c7_respiratory_notch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window without its session's own respiration rate and its double."""
    return E.without_respiration(E.respiration(_green(spark, sf_dir), FPS), FPS)


_SEGS = f"""{_WINS}, segs AS (SELECT session, w, s, x[s + 1 : s + 100] AS x, 100 AS n FROM (SELECT *, unnest(range(0, n - 99, 50)) AS s FROM wins WHERE n >= 100)),
{_magnitudes('segs', 'seg')}, {_picked('seg', 'vote', '0.1::DOUBLE')}, votes AS (SELECT session, w, list(hz ORDER BY s) AS votes FROM vote GROUP BY ALL),
whole AS (SELECT session, w, x, n FROM wins WHERE n >= 30), {_magnitudes('whole', 'spec')}, {_picked('spec', 'one', f'({FPS}::DOUBLE / n)')},
groups AS (SELECT *, list_transform(votes, lambda v: list_filter(votes, lambda o: abs(o - v) < 0.08)) AS g FROM votes),
voted AS (SELECT session, w, votes, list_median(list_filter(g, lambda v: len(v) = list_max(list_transform(g, lambda o: len(o))))[1]) AS rate FROM groups WHERE len(votes) >= 2),
rates AS (SELECT wins.session, wins.w, coalesce(voted.votes, []) AS votes, coalesce(voted.rate, one.hz, 0) AS rate, coalesce(list_transform(list_filter(range(len(spec.m)), lambda k: k * {FPS} / spec.n BETWEEN {E.BAND[0]} AND {E.BAND[1]}), lambda k: {{'hz': k * {FPS} / spec.n, 'm': spec.m[k + 1]}}), []) AS band,
  row_number() OVER (PARTITION BY wins.session ORDER BY wins.w) AS t FROM wins LEFT JOIN voted USING (session, w) LEFT JOIN one ON one.session = wins.session AND one.w = wins.w LEFT JOIN spec ON spec.session = wins.session AND spec.w = wins.w)"""


def _near(hz: str) -> str:
    return f"coalesce(list_sum(list_transform(list_filter(band, lambda e: e.hz >= {hz} - 0.12 AND e.hz <= {hz} + 0.12), lambda e: e.m)), 0)"


@query(f"""WITH RECURSIVE {_SEGS}, k AS (SELECT DISTINCT session, 0::BIGINT AS t, NULL::BIGINT AS w, []::DOUBLE[] AS known, 0::DOUBLE AS fixed, 0::DOUBLE AS consistency, 0::DOUBLE AS jump, false AS corrected, 0::DOUBLE AS dominance FROM rates
UNION ALL SELECT session, t, w, CASE WHEN fixed <> r2 THEN list_append(known2, fixed)[-12:] ELSE known2 END, fixed, consistency * CASE WHEN jump > 15 THEN 0.5 ELSE 1.0 END, jump, fixed <> r2,
  coalesce(list_max(list_transform(list_filter(band, lambda e: e.hz >= fixed - 0.1 AND e.hz <= fixed + 0.1), lambda e: e.m)) / (list_sum(list_transform(band, lambda e: e.m)) + 1e-9), 0)
FROM (SELECT *, CASE WHEN r2 > 0 AND own >= 1e-12 AND r2 / 2 >= {E.BAND[0]} AND {_near('r2 / 2')} >= 0.30 * own THEN r2 / 2 WHEN r2 > 0 AND own >= 1e-12 AND r2 < 1.25 AND 2 * r2 <= band[-1].hz AND {_near('2 * r2')} >= 0.40 * own THEN 2 * r2 ELSE r2 END AS fixed FROM (
  SELECT *, {_near('r2')} AS own, CASE WHEN len(known) >= 3 THEN abs(r2 - list_median(known)) * 60 ELSE 0 END AS jump, list_append(known, r2)[-12:] AS known2 FROM (
  SELECT *, CASE WHEN len(known) >= 5 THEN exp(-abs(rate - mid) / 0.20) ELSE 1.0 END AS consistency, CASE WHEN len(known) >= 5 AND list_stddev_pop(known) < 0.08 AND abs(rate - mid) > 0.18 AND len(votes) >= 2 AND
    len(list_filter(votes, lambda v: abs(v - mid) < 0.08)) >= len(list_filter(votes, lambda v: abs(v - rate) < 0.08)) THEN mid ELSE rate END AS r2 FROM (
  SELECT r.session, r.t, r.w, r.votes, r.rate, r.band, k.known, list_median(k.known) AS mid FROM k JOIN rates r ON r.session = k.session AND r.t = k.t + 1) a) b) c) d)
SELECT session, w, {r4('60 * fixed')} AS bpm, {r4('consistency')} AS consistency, {r4('jump')} AS jump, corrected, {r4('dominance')} AS dominance FROM k WHERE t > 0""")
def d1_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments' votes and each supplier's history, ten samples a second."""
    out = E.estimates(_green(spark, sf_dir), FPS)
    return out.select("session", F.col("seq").alias("w"), *(rounded(F.col(c)).alias(c) for c in ("bpm", "consistency", "jump", "dominance")), "corrected")


@query(f"""WITH {RGB}, ends AS (SELECT session, max(seq) AS e FROM rgb GROUP BY session), starts AS (SELECT session, unnest(range(0, e - 100, 10)) AS s FROM ends), x AS (SELECT st.session, s, seq - 1 - s AS i, g - avg(g) OVER (PARTITION BY st.session, s) AS v FROM starts st JOIN rgb r ON r.session = st.session AND seq > s AND seq <= s + 100),
b AS (SELECT session, s, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 99)) * cos(2 * pi() * k * i / 100)) ** 2 + sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 99)) * sin(2 * pi() * k * i / 100)) ** 2 AS p FROM x, range(5, 41) r(k) GROUP BY ALL), t AS (SELECT session, s, arg_max(k, (p, -k)) * 6.0 AS bpm FROM b GROUP BY ALL)
SELECT session, (s + 50) / 10.0::DOUBLE AS t, {r4('bpm')} AS bpm FROM t WHERE bpm BETWEEN 40 AND 180""")
def d4_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten seconds every second, stamped by their centres, without the last; ten samples a second."""
    s = rgb(spark, sf_dir).select("session", F.col("seq").cast("bigint").alias("seq"), F.col("g").alias("x"))
    return E.window_rates(s, FPS).withColumn("bpm", rounded(F.col("bpm")))


_BEFORE = "CASE WHEN (session + w) % 4 > 0 THEN 40.0 + (session * 7 + w * 13) % 90 END"


@query(f"""WITH {_WINS}, whole AS (SELECT session, w, x, n FROM wins), {_magnitudes('whole', 'spec')}, {_picked('spec', 'one', f'({FPS}::DOUBLE / n)', _BEFORE)}
SELECT session, w, {r4('60 * hz')} AS bpm FROM one""")
def d2_one_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak of each window with a rate before it that is made up from its number, or none."""
    before = F.when((F.col("session") + F.col("w")) % 4 > 0, 40.0 + (F.col("session") * 7 + F.col("w") * 13) % 90)
    wins = _green(spark, sf_dir).select("session", "w", F.array_append("x", before).alias("x"))  # the rate goes along as one more value

    def pick(rows):
        last = [None if r[-1] != r[-1] else r[-1] for r in rows]
        return [{"hz": E.one_peak(E.spectrum(r[:-1]), FPS / (len(r) - 1), b)} for r, b in zip(rows, last, strict=True)]

    return E.by_window(wins, pick, "hz double").select("session", "w", rounded(60 * F.col("hz")).alias("bpm"))


@query()
def d1_filtered_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak after the band-pass of windows of users' events, four samples a second."""
    s = signal(spark, sf_dir).select("session", F.col("seq").cast("bigint").alias("seq"), "x")
    return E.by_window(E.windows(s, 64, 32), E.each(lambda x: {"bpm": E.filtered_rate(x, 8.0)}), "bpm double")


_WELCH = """wp AS (SELECT session, w, s, unnest(x) AS v, unnest(range(size)) AS i, size FROM parts), wc AS (SELECT session, w, s, i, size, (v - avg(v) OVER (PARTITION BY session, w, s)) * (0.5 - 0.5 * cos(2 * pi() * i / size)) AS v FROM wp),
wb AS (SELECT session, w, s, size, k, sum(v * cos(2 * pi() * (k * i % size) / size)) ** 2 + sum(v * sin(2 * pi() * (k * i % size) / size)) ** 2 AS p FROM wc, range(0, 51) r(k) WHERE k <= size // 2 GROUP BY ALL),
psd AS (SELECT session, w, k, {fps} * k / size AS hz, avg(p) * CASE WHEN k = 0 OR (size % 2 = 0 AND k = size // 2) THEN 1 ELSE 2 END / ({fps} * size * 0.375) AS p FROM wb GROUP BY session, w, k, size)"""


@query(f"""WITH {_WINS}, lens AS (SELECT *, least(n, 100) AS size FROM wins WHERE n >= 30), parts AS (SELECT session, w, size, s, x[s + 1 : s + size] AS x FROM (SELECT *, unnest(range(0, n - size + 1, size - size // 2)) AS s FROM lens)), {_WELCH.format(fps=FPS)}
SELECT session, w, {r4('arg_max(hz, (p, -k))')} AS resp_hz FROM psd WHERE hz BETWEEN 0.1 AND 1.5 GROUP BY ALL""")
def d7_breathing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest rate of a Welch spectrum of ten seconds a segment."""
    out = E.by_window(_green(spark, sf_dir).where("size(x) >= 30"), E.each(lambda x: E.breathing(x, FPS)), "resp_hz double")
    return out.withColumn("resp_hz", rounded(F.col("resp_hz")))


@query(f"""WITH {_WINS}, lens AS (SELECT *, least(n, 80) AS size FROM wins WHERE n >= 20), parts AS (SELECT session, w, size, s, x[s + 1 : s + size] AS x FROM (SELECT *, unnest(range(0, n - size + 1, size - size // 2)) AS s FROM lens)), {_WELCH.format(fps=FPS)}
SELECT session, w, {r4('sum(p) FILTER (hz BETWEEN 0.1 AND 1.5) / (sum(p) FILTER (hz BETWEEN 0.83 AND 3.0) + 1e-9)')} AS interference FROM psd GROUP BY ALL""")
def d7_interference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of breathing by that of the pulse, from a Welch spectrum of eight seconds a segment."""
    out = E.by_window(_green(spark, sf_dir).where("size(x) >= 20"), E.each(lambda x: E.breathing(x, FPS)), "interference double")
    return out.withColumn("interference", rounded(F.col("interference")))


_PROMINENT = """z[k + 1] - greatest(list_min(z[coalesce(list_max(list_filter(range(0, k), lambda j: z[j + 1] > z[k + 1])), 0) + 1 : k + 1]),
  list_min(z[k + 1 : coalesce(list_min(list_filter(range(k + 1, n), lambda j: z[j + 1] > z[k + 1])), n - 1) + 1])) >= 0.25"""


@query(f"""WITH {_WINS}, zs AS (SELECT session, w, n, list_transform(x, lambda v: (v - list_avg(x)) / (list_stddev_pop(x) + 1e-9)) AS z FROM wins),
tops AS (SELECT *, list_sort(list_transform(list_filter(range(1, n - 1), lambda k: z[k + 1] > z[k] AND z[k + 1] > z[k + 2]), lambda k: {{'p': -z[k + 1], 'k': -k}})) AS t FROM zs),
kept AS (SELECT *, list_sort(list_transform(list_reduce(t, lambda a, e: CASE WHEN len(list_filter(a, lambda o: abs(o.k - e.k) < 3)) = 0 THEN list_append(a, e) ELSE a END, []::STRUCT(p DOUBLE, k BIGINT)[]), lambda e: -e.k)) AS ks FROM tops),
beats AS (SELECT session, w, list_filter(ks, lambda k: {_PROMINENT}) AS ks FROM kept),
gaps AS (SELECT session, w, list_transform(range(1, len(ks)), lambda i: (ks[i + 1] - ks[i]) * 100.0) AS g FROM beats), near AS (SELECT session, w, CASE WHEN len(g) >= 2 THEN list_filter(g, lambda v: v > 0.6 * list_median(g) AND v < 1.6 * list_median(g)) ELSE [] END AS g FROM gaps),
steps AS (SELECT *, list_transform(range(1, len(g)), lambda i: g[i + 1] - g[i]) AS d FROM near)
SELECT session, w, len(g) AS n, CASE WHEN len(g) >= 5 THEN {r4('list_stddev_pop(g)')} END AS sdnn, CASE WHEN len(g) >= 5 THEN {r4('sqrt(list_avg(list_transform(d, lambda v: v * v)))')} END AS rmssd,
  CASE WHEN len(g) >= 5 THEN {r4('100 * list_avg(list_transform(d, lambda v: CASE WHEN abs(v) > 50 THEN 1.0 ELSE 0.0 END))')} END AS pnn50 FROM steps""")
def g12_peak_hrv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variability of the intervals between peaks of each window."""
    return _variability(spark, sf_dir).drop("lf_hf")


@query()
def g12_lf_hf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio of slow to fast variation of the same intervals (0 for fewer than twenty)."""
    return _variability(spark, sf_dir).select("session", "w", "n", "lf_hf")


def _variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.by_window(_green(spark, sf_dir), E.each(lambda x: E.variability(x, FPS)), "n long, sdnn double, rmssd double, pnn50 double, lf_hf double")
    return out.withColumns({c: rounded(F.col(c)) for c in ("sdnn", "rmssd", "pnn50", "lf_hf")})
