"""SQL of the ordered stages (cadence, segments, grid, repair), written once and shared by the oracles."""

from __future__ import annotations

from tidewatch.plans.views import MEASURES

TARGETS = ("cpu_percent", "mem_percent")


def each(template: str, cols=MEASURES) -> str:
    return ", ".join(template.format(c=c) for c in cols)


def clip(c: str) -> str:
    top = "100.0" if c in TARGETS else "NULL"
    bounded = f"least({c}, {top})" if c in TARGETS else c
    return f"CASE WHEN {c} IS NOT NULL THEN greatest({bounded}, 0.0) END AS {c}"


def dedup_sql(base: str, out: str = "dedup") -> str:
    return f"{out} AS (SELECT series_key, ts, {each('avg({c}) AS {c}')} FROM {base} WHERE ts IS NOT NULL GROUP BY series_key, ts)"


def clipped_sql(base: str, out: str = "clipped") -> str:
    return f"{out} AS (SELECT series_key, ts, {', '.join(clip(c) for c in MEASURES)} FROM {base})"


def steps_sql(base: str, out: str = "steps") -> str:
    return f"""{out} AS (SELECT *, lag(ts) OVER s AS prev_ts, (epoch_us(ts) - epoch_us(lag(ts) OVER s)) / 1e6 AS delta
  FROM {base} WHERE ts IS NOT NULL WINDOW s AS (PARTITION BY series_key ORDER BY ts))"""


def cadence_sql(steps: str = "steps", out: str = "cadence") -> str:
    return f"""{out} AS (SELECT series_key, coalesce(CASE WHEN count(*) >= 3 THEN median(delta) FILTER (WHERE delta > 0) END, 3.0) AS cadence
  FROM {steps} GROUP BY series_key)"""


def segments_sql(steps: str = "steps", out: str = "seg") -> str:
    return f"""{out} AS (SELECT t.*, cadence, row_number() OVER s - 1 AS pos,
  CAST(sum(CASE WHEN delta > cadence * 2.0 THEN 1 ELSE 0 END) OVER (s ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id
  FROM {steps} t JOIN cadence USING (series_key) WINDOW s AS (PARTITION BY series_key ORDER BY ts))"""


def grid_sql(seg: str = "seg", out: str = "grid") -> str:
    return f"""started AS (SELECT *, min(ts) OVER (PARTITION BY series_key, segment_id) AS segment_start,
  CAST(round_even(cadence * 1000.0, 0) AS BIGINT) * 1000 AS step FROM {seg}),
slotted AS (SELECT *, (epoch_us(ts) - epoch_us(segment_start)) // step AS slot FROM started),
occupied AS (SELECT series_key, segment_id, slot, {each('avg({c}) AS {c}')}, count(*) AS observations FROM slotted GROUP BY series_key, segment_id, slot),
axis AS (SELECT series_key, segment_id, any_value(segment_start) AS segment_start, any_value(step) AS step,
  unnest(range(0, max(slot) + 1)) AS slot FROM slotted GROUP BY series_key, segment_id),
{out} AS (SELECT a.series_key, a.segment_id, a.slot, make_timestamp(epoch_us(a.segment_start) + a.slot * a.step) AS ts, {each('o.{c}')},
  CASE WHEN o.slot IS NULL THEN 1 ELSE 0 END AS is_imputed, coalesce(observations, 0) AS observations
  FROM axis a LEFT JOIN occupied o ON a.series_key = o.series_key AND a.segment_id = o.segment_id AND a.slot = o.slot)"""


def hampel_sql(grid: str = "grid", out: str = "flagged") -> str:
    frame = "PARTITION BY series_key, segment_id ORDER BY slot ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING"
    med = each(f"CASE WHEN count({{c}}) OVER ({frame}) >= 3 THEN quantile_cont({{c}}, 0.5) OVER ({frame}) END AS m_{{c}}", TARGETS)
    mad = each(f"CASE WHEN count(d_{{c}}) OVER ({frame}) >= 3 THEN quantile_cont(d_{{c}}, 0.5) OVER ({frame}) END AS a_{{c}}", TARGETS)
    flag = each("CASE WHEN abs(0.6745 * ({c} - m_{c}) / nullif(a_{c}, 0)) > 3.5 THEN 1 ELSE 0 END AS {c}_is_outlier", TARGETS)
    return f"""h1 AS (SELECT *, {med} FROM {grid}),
h2 AS (SELECT *, {each('abs({c} - m_{c}) AS d_{c}', TARGETS)} FROM h1),
h3 AS (SELECT *, {mad} FROM h2),
h4 AS (SELECT *, {flag} FROM h3),
{out} AS (SELECT *, greatest({each('{c}_is_outlier', TARGETS)}) AS is_outlier FROM h4)"""


def known_sql(cols, back: str = "back", ahead: str = "ahead") -> str:
    parts = []
    for c in cols:
        pos = f"CASE WHEN {c} IS NOT NULL THEN slot END"
        parts += [
            f"last_value({c} IGNORE NULLS) OVER {back} AS pv_{c}",
            f"last_value({pos} IGNORE NULLS) OVER {back} AS pp_{c}",
            f"first_value({c} IGNORE NULLS) OVER {ahead} AS nv_{c}",
            f"first_value({pos} IGNORE NULLS) OVER {ahead} AS np_{c}",
        ]
    return ", ".join(parts)


FRAMES = """WINDOW back AS (PARTITION BY series_key, segment_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  ahead AS (PARTITION BY series_key, segment_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


def impute_sql(flagged: str = "flagged", out: str = "imputed") -> str:
    fill = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN pv_{c} IS NOT NULL AND nv_{c} IS NOT NULL AND least(slot - pp_{c}, np_{c} - slot) <= 3 "
        f"THEN pv_{c} + (nv_{c} - pv_{c}) * (slot - pp_{c}) / (np_{c} - pp_{c}) END AS f_{c}"
        for c in MEASURES
    )
    return f"""around AS (SELECT *, {known_sql(MEASURES)} FROM {flagged} {FRAMES}),
{out} AS (SELECT *, {fill} FROM around)"""


def clean_sql(imputed: str = "imputed", out: str = "clean") -> str:
    return f"""{out} AS (SELECT series_key, segment_id, slot, ts, {each('f_{c} AS {c}')}, is_imputed, observations, is_outlier,
  {each('{c}_is_outlier', TARGETS)}, {each('CASE WHEN {c} IS NULL AND f_{c} IS NOT NULL THEN 1 ELSE 0 END AS filled_{c}')}
  FROM {imputed} WHERE f_cpu_percent IS NOT NULL AND f_mem_percent IS NOT NULL)"""


def to_clean(base: str) -> list[str]:
    """Every CTE from raw samples to the clean series."""
    return [
        dedup_sql(base), clipped_sql("dedup"), steps_sql("clipped"), cadence_sql(), segments_sql(), grid_sql(), hampel_sql(), impute_sql(), clean_sql(),
    ]


def to_segments(base: str) -> list[str]:
    return [dedup_sql(base), clipped_sql("dedup"), steps_sql("clipped"), cadence_sql(), segments_sql()]


def ewma_sql(c: str, span: int, by: str = "series_key, segment_id") -> str:
    a = 2.0 / (span + 1)
    frame = f"PARTITION BY {by} ORDER BY ts ROWS UNBOUNDED PRECEDING"
    return f"list_reduce(list({c}) OVER ({frame}), lambda y, x: {a!r} * x + {1 - a!r} * y)"


def features_sql(target: str, clean: str = "clean", out: str = "feat", shift: int = 1) -> str:
    """Feature frame of a quality target, the SQL twin of `feature_frame`."""
    t, w = target, "PARTITION BY series_key, segment_id ORDER BY ts"
    frame = f"({w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    lags = ", ".join(f"lag({t}, {k}) OVER ({w}) AS {t}_lag_{k}" for k in (0, 1, 3, 5, 10, 20))
    roll = ", ".join(
        f"CASE WHEN count({t}) OVER {frame} >= 2 THEN {fn}({t}) OVER {frame} END AS {t}_roll_{n}"
        for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min"))
    )
    return f"""fa AS (SELECT *, {lags}, {roll}, {t} - lag({t}) OVER ({w}) AS {t}_delta,
  {ewma_sql(t, 3)} AS {t}_ewma_fast, {ewma_sql(t, 10)} AS {t}_ewma_slow, 100.0 - {t} AS {t}_headroom,
  lead({t}, {shift}) OVER ({w}) AS target_next FROM {clean}),
{out} AS (SELECT *, {t}_ewma_fast - {t}_ewma_slow AS {t}_trend, {t} * coalesce({t}_roll_std, 0) AS {t}_level_x_vol,
  coalesce({t}_delta, 0) * coalesce({t}_roll_std, 0) AS {t}_slope_x_vol,
  (100.0 - {t}) / greatest(coalesce({t}_delta, 0), 0.05) AS {t}_steps_to_saturation,
  coalesce(({t} - {t}_roll_mean) / nullif({t}_roll_std, 0), 0) AS {t}_zscore_local,
  extract(hour FROM ts) AS hour, extract(minute FROM ts) AS minute, extract(second FROM ts) AS second_of_minute, (extract(isodow FROM ts) - 1) AS dayofweek
  FROM fa)"""


def feature_cols(target: str) -> list[str]:
    """Features that can be null or vary; calendar and companions are complete on clean rows."""
    t = target
    return (
        [f"{t}_lag_{k}" for k in (0, 1, 3, 5, 10, 20)]
        + [f"{t}_roll_{s}" for s in ("mean", "std", "max", "min")]
        + [f"{t}_{d}" for d in ("delta", "ewma_fast", "ewma_slow", "trend", "headroom")]
        + [f"{t}_{i}" for i in ("level_x_vol", "slope_x_vol", "steps_to_saturation", "zscore_local")]
    )


def usable_sql(target: str, feat: str = "feat", out: str = "usable") -> str:
    """Complete rows numbered per series (rn, n). Companion columns must be known as well."""
    cond = " AND ".join(f"{c} IS NOT NULL" for c in [*feature_cols(target), "target_next", "cpu_percent", "mem_percent", "disk_read_mb_s"])
    return f"""{out} AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY series_key) AS n
  FROM {feat} WHERE {cond})"""
