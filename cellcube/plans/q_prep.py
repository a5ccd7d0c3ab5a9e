"""Checked queries: dense grid, sequences and train-fitted preparation
(N-01 .. N-05, N-07, N-08, M-02 .. M-08, M-15, A-08)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from cellcube.config import DYNAMIC_COLUMNS
from cellcube.operators import prep as M
from cellcube.operators import series as N
from cellcube.operators import summary as A
from cellcube.operators.joins import bounded_broadcast
from cellcube.plans.q_features import TRAINING_FIXTURES, WITH_TRAINING, training, training_stored
from cellcube.plans.registry import register, rnd, rnd_sql, round_doubles
from cellcube.sources import fixtures as fx

SPLIT = fx.FIXTURE_SPLIT
SEQ_COLS = DYNAMIC_COLUMNS
GONE = (1998, 5)     # a month whose layers are taken out, so that the calendar has a hole

SQL_TS = """ts AS (SELECT year, month, CAST(row_number() OVER (ORDER BY year, month) - 1 AS INTEGER) AS t_idx
           FROM (SELECT DISTINCT year, month FROM tt) d)"""
SQL_DENSE = SQL_TS + """,
cellax AS (SELECT CAST(unnest(range((SELECT nc FROM dims))) AS INTEGER) AS pixel_idx),
dn AS (SELECT ts.t_idx, c.pixel_idx, ts.year, ts.month, tt.log_ndvi, tt.lst_driver_lag1, tt.pop_density
       FROM ts CROSS JOIN cellax c
       LEFT JOIN tt ON tt.pixel_idx = c.pixel_idx AND tt.year = ts.year AND tt.month = ts.month)"""


def _split_sql(col: str = "year") -> str:
    return f"CASE WHEN {col} <= 1999 THEN 'train' WHEN {col} <= 2000 THEN 'val' ELSE 'test' END"


def _scaled_sql(cols: list[str]) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    return f"""st AS (SELECT {stats} FROM dn WHERE year <= 1999),
sc AS (SELECT dn.*, {", ".join(f"coalesce((dn.{c} - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1e0 ELSE s_{c} END, 0e0) AS z_{c}" for c in cols)}
       FROM dn, st)"""


def _dense(spark, sf_dir, t=None):
    t = training_stored(spark, sf_dir) if t is None else t
    times = N.timesteps(t, calendar=False)
    return N.dense_grid(spark, t, fx.grid(spark, sf_dir).n_cells, times, ["log_ndvi", "lst_driver_lag1", "pop_density"])


def _dense_scaled(spark, sf_dir, cols):
    t = training_stored(spark, sf_dir)
    # cells without a row do not count: the stored table gives the same statistics as the dense grid
    sc = M.fit_scaler(t.where(F.col("year") <= SPLIT.train_end), cols, split=None, fit_on=None)
    d = _dense(spark, sf_dir, t)
    return M.zero_fill(M.standardize(d, cols, sc), cols), sc


@register("n01_timesteps", WITH_TRAINING(f", {SQL_TS} SELECT year, month, t_idx FROM ts"),
          TRAINING_FIXTURES)
def q_timesteps(spark, sf_dir):
    """N-01: distinct (year, month) of the training table with positional index."""
    return N.timesteps(training(spark, sf_dir), calendar=False)


@register("n02_dense_grid", WITH_TRAINING(f""", {SQL_DENSE}
    SELECT t_idx, pixel_idx, year, month, {rnd_sql('log_ndvi')} AS log_ndvi, {rnd_sql('pop_density')} AS pop_density
    FROM dn"""), TRAINING_FIXTURES)
def q_dense_grid(spark, sf_dir):
    """N-02: every (timestep, cell) of the grid, observed values or NULL."""
    return round_doubles(_dense(spark, sf_dir).select("t_idx", "pixel_idx", "year", "month", "log_ndvi",
                                                     "pop_density"))


@register("n03_static_by_pixel", WITH_TRAINING(f"""
    SELECT pixel_idx, {rnd_sql('arg_min(twi, t)')} AS twi, arg_min(soil_snum, t) AS soil_snum
    FROM tt GROUP BY pixel_idx"""), TRAINING_FIXTURES)
def q_static_by_pixel(spark, sf_dir):
    """N-03: static vector of each cell from its earliest valid row."""
    t = training(spark, sf_dir).withColumn("t_idx", F.col("year") * 12 + F.col("month"))
    return round_doubles(N.static_by_pixel(t, ["twi", "soil_snum"]))


@register("m06_zero_fill", WITH_TRAINING(f""", {SQL_DENSE}, {_scaled_sql(['log_ndvi', 'pop_density'])}
    SELECT t_idx, pixel_idx, {rnd_sql('z_log_ndvi')} AS log_ndvi, {rnd_sql('z_pop_density')} AS pop_density FROM sc"""),
          TRAINING_FIXTURES)
def q_zero_fill(spark, sf_dir):
    """M-04 + M-06 on the dense grid: train-fitted z-scores, then missing -> 0."""
    d, _ = _dense_scaled(spark, sf_dir, ["log_ndvi", "pop_density"])
    return round_doubles(d.select("t_idx", "pixel_idx", "log_ndvi", "pop_density"))


@register("m07_inverse_scale", WITH_TRAINING(f""", {SQL_DENSE}, {_scaled_sql(['log_ndvi'])}
    SELECT t_idx, pixel_idx, {rnd_sql('z_log_ndvi * CASE WHEN s_log_ndvi = 0 THEN 1e0 ELSE s_log_ndvi END + m_log_ndvi')}
           AS log_ndvi
    FROM sc, st WHERE sc.log_ndvi IS NOT NULL"""), TRAINING_FIXTURES)
def q_inverse_scale(spark, sf_dir):
    """M-07: scaled target back to log space with the stored train scaler."""
    dense = M.chrono_split(_dense(spark, sf_dir), SPLIT.train_end, SPLIT.val_end)
    sc = M.fit_scaler(dense, ["log_ndvi"])
    observed = dense.where(F.col("log_ndvi").isNotNull())
    m, s = sc["log_ndvi"]
    back = M.inverse_scale(M.standardize(observed, ["log_ndvi"], sc), "log_ndvi", m, s)
    return round_doubles(back.select("t_idx", "pixel_idx", "log_ndvi"))


_Z = ", ".join(f"coalesce((c.{x} - m_{x}) / CASE WHEN s_{x} = 0 OR s_{x} IS NULL THEN 1e0 ELSE s_{x} END, 0e0) AS z_{x}" for x in SEQ_COLS)
_STATS = ", ".join(f"avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}" for x in SEQ_COLS)
_STEPS = ", ".join("(" + " + ".join(f"{13 - k} * lag(z_{x}, {k}) OVER w" for k in range(12, 0, -1)) + f") / 78e0 AS x_{x}" for x in SEQ_COLS)
SQL_CALENDAR = f"""tg AS (SELECT * FROM tt WHERE NOT (year = {GONE[0]} AND month = {GONE[1]})),
ends AS (SELECT min(year * 12 + month - 1) AS a, max(year * 12 + month - 1) AS b FROM tg),
cal AS (SELECT CAST(ym // 12 AS INTEGER) AS year, CAST(ym % 12 + 1 AS INTEGER) AS month, CAST(ym - (SELECT a FROM ends) AS INTEGER) AS t_idx
        FROM (SELECT unnest(range((SELECT a FROM ends), (SELECT b + 1 FROM ends))) AS ym) u)"""
SQL_SEQ = f""", {SQL_CALENDAR},
cellax AS (SELECT CAST(unnest(range((SELECT nc FROM dims))) AS INTEGER) AS pixel_idx),
c AS (SELECT cal.t_idx, cal.year, cal.month, cellax.pixel_idx, {", ".join("tg." + x for x in SEQ_COLS)}
      FROM cal CROSS JOIN cellax LEFT JOIN tg ON tg.pixel_idx = cellax.pixel_idx AND tg.year = cal.year AND tg.month = cal.month),
st AS (SELECT {_STATS} FROM c WHERE year <= 1999),
sc AS (SELECT c.t_idx, c.year, c.month, c.pixel_idx, {_Z} FROM c, st),
sq AS (SELECT pixel_idx, t_idx, year, month, z_log_ndvi AS y,
              count(*) OVER (PARTITION BY pixel_idx ORDER BY t_idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS n_steps, {_STEPS}
       FROM sc WINDOW w AS (PARTITION BY pixel_idx ORDER BY t_idx)),
sp AS (SELECT pixel_idx, arg_min(twi, t) AS twi, arg_min(CAST(soil_snum AS DOUBLE), t) AS soil FROM tg GROUP BY 1),
ss AS (SELECT avg(twi) AS mt, stddev_pop(twi) AS dt, avg(soil) AS ms, stddev_pop(soil) AS ds FROM sp),
sz AS (SELECT pixel_idx, (twi - mt) / CASE WHEN dt = 0 THEN 1e0 ELSE dt END AS twi, (soil - ms) / CASE WHEN ds = 0 THEN 1e0 ELSE ds END AS soil FROM sp, ss)"""


def _weighed(s, *more):
    """Every element of a window enters the result: column ``x_<name>`` is the mean of its twelve
    steps with weights 1 to 12."""
    def mean(j: int):
        steps = F.transform("x", lambda step, k: (k + 1) * step[j])
        return F.aggregate(steps, F.lit(0.0), lambda total, v: total + v) / 78

    return s.select("pixel_idx", *more, *[mean(j).alias(f"x_{c}") for j, c in enumerate(SEQ_COLS)], "y")


def _calendar_grid(spark, sf_dir):
    """The training table without one month, and its scaled, zero-filled calendar grid."""
    gone = (F.col("year") == GONE[0]) & (F.col("month") == GONE[1])
    t = training_stored(spark, sf_dir).where(~gone)
    grid = fx.grid(spark, sf_dir)
    times = N.timesteps(t)
    # scaler statistics from the stored table: cells without a row do not count
    sc = M.fit_scaler(t.where(F.col("year") <= SPLIT.train_end), SEQ_COLS, split=None, fit_on=None)
    dense = M.zero_fill(M.standardize(N.dense_grid(spark, t, grid.n_cells, times, SEQ_COLS), SEQ_COLS, sc), SEQ_COLS)
    return t, dense


def _sequences(spark, sf_dir):
    """All dynamic columns and the static block."""
    t, dense = _calendar_grid(spark, sf_dir)
    s = N.sequences(dense, SEQ_COLS, "log_ndvi", window=12)
    fixed = N.static_by_pixel(t.withColumn("t_idx", F.col("year") * 12 + F.col("month")), ["twi", "soil_snum"])
    fixed = M.standardize_static(fixed.withColumn("soil_snum", F.col("soil_snum").cast("double")).checkpoint(), ["twi", "soil_snum"])

    out = _weighed(s, "t_idx", "year", "month", F.size("x").alias("n_steps"))
    return out.join(fixed.select("pixel_idx", F.col("twi").alias("static_twi"), F.col("soil_snum").alias("static_soil")), "pixel_idx", "left")


_SEQ_OUT = ", ".join(f"{rnd_sql('sq.x_' + x)} AS x_{x}" for x in SEQ_COLS)


@register("n01_timesteps_calendar", WITH_TRAINING(f", {SQL_CALENDAR} SELECT year, month, t_idx FROM cal"), TRAINING_FIXTURES)
def q_timesteps_calendar(spark, sf_dir):
    """N-01 by calendar: every month from the first to the last, also the one without layers."""
    gone = (F.col("year") == GONE[0]) & (F.col("month") == GONE[1])
    return N.timesteps(training_stored(spark, sf_dir).where(~gone))


@register("n04_sequences", WITH_TRAINING(SQL_SEQ + f"""
    SELECT sq.pixel_idx, t_idx, year, month, CAST(n_steps AS INTEGER) AS n_steps, {_SEQ_OUT}, {rnd_sql('y')} AS y,
           {rnd_sql('sz.twi')} AS static_twi, {rnd_sql('sz.soil')} AS static_soil
    FROM sq LEFT JOIN sz ON sz.pixel_idx = sq.pixel_idx WHERE t_idx >= 12"""), TRAINING_FIXTURES)
def q_sequences(spark, sf_dir):
    """N-04: 12-month windows of all dynamic columns with the scaled static block, on the
    calendar grid (one month has no layers), train-scaled and zero-filled."""
    return round_doubles(_sequences(spark, sf_dir))


@register("n05_find_window", WITH_TRAINING(SQL_SEQ + f"""
    SELECT sq.pixel_idx, {_SEQ_OUT}, {rnd_sql('y')} AS y
    FROM sq WHERE t_idx >= 12 AND year = 2000 AND month = 6"""), TRAINING_FIXTURES)
def q_find_window(spark, sf_dir):
    """N-05: the samples whose target month is 2000-06, all dynamic columns; only the 13 months
    that they hold are read."""
    _, dense = _calendar_grid(spark, sf_dir)
    return round_doubles(_weighed(N.window_at(dense, SEQ_COLS, "log_ndvi", 2000, 6, window=12)))


@register("n07_grid_rows", f"""
    WITH mt AS (SELECT pixel_idx, avg(exp(true_log_ndvi)) AS v FROM residuals WHERE split = 'test' GROUP BY pixel_idx),
    rows_ AS (SELECT CAST(unnest(range((SELECT h FROM dims))) AS INTEGER) AS "row")
    SELECT r."row", 10 AS n_cols, CAST(count(mt.v) AS INTEGER) AS n_present,
           {rnd_sql('sum(mt.v)')} AS row_sum,
           {rnd_sql('max(CASE WHEN mt.pixel_idx % 10 = 0 THEN mt.v END)')} AS first_value,
           {rnd_sql('max(CASE WHEN mt.pixel_idx % 10 = 9 THEN mt.v END)')} AS last_value
    FROM rows_ r LEFT JOIN mt ON mt.pixel_idx // 10 = r."row"
    GROUP BY r."row" """, ("cells", "residuals"))
def q_grid_rows(spark, sf_dir):
    """N-07: per-cell mean observed index of the test split laid out as the 8 x 10
    matrix (one array per grid row), summarised per row."""
    per_cell = A.observed_vs_predicted(fx.residuals(spark, sf_dir).where(F.col("split") == "test"),
                                       "true_log_ndvi", "XGBoost_pred")
    g = N.grid_rows(spark, per_cell, fx.grid(spark, sf_dir), "mean_true_ndvi")
    present = F.filter("values", lambda x: x.isNotNull())
    return g.select("row", F.size("values").alias("n_cols"), F.size(present).alias("n_present"),
                    rnd(F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x))).alias("row_sum"),
                    rnd(F.col("values")[0]).alias("first_value"),
                    rnd(F.col("values")[fx.grid(spark, sf_dir).width - 1]).alias("last_value"))


@register("n08_unflatten_predictions", f"""
    WITH ts AS (SELECT year, month, CAST(row_number() OVER (ORDER BY year, month) - 1 AS INTEGER) AS t_idx
                FROM (SELECT DISTINCT year, month FROM residuals WHERE split = 'test') d),
    fl AS (SELECT ts.t_idx, r.pixel_idx, r.RF_pred AS pred
           FROM residuals r JOIN ts ON ts.year = r.year AND ts.month = r.month WHERE r.split = 'test'),
    cellax AS (SELECT CAST(unnest(range((SELECT nc FROM dims))) AS INTEGER) AS pixel_idx)
    SELECT ts.t_idx, c.pixel_idx, ts.year, ts.month, {rnd_sql('fl.pred')} AS pred
    FROM ts CROSS JOIN cellax c LEFT JOIN fl ON fl.t_idx = ts.t_idx AND fl.pixel_idx = c.pixel_idx""",
          ("cells", "residuals"))
def q_unflatten(spark, sf_dir):
    """N-08: a flat (timestep-major, cell-minor) test prediction vector back to
    keyed (timestep, cell) rows, padded with NULL where no prediction exists."""
    r = fx.residuals(spark, sf_dir).where(F.col("split") == "test")
    times = N.timesteps(r, calendar=False)
    flat = (r.join(bounded_broadcast(times, N.MAX_MONTHS), ["year", "month"])
            .select((F.col("t_idx").cast("long") * fx.grid(spark, sf_dir).n_cells + F.col("pixel_idx")).alias("pos"),
                    F.col("RF_pred").alias("pred")))
    out = N.unflatten_predictions(spark, flat, fx.grid(spark, sf_dir).n_cells, times)
    return round_doubles(out.select("t_idx", "pixel_idx", "year", "month", "pred"))


@register("m02_one_hot", WITH_TRAINING("""
    SELECT pixel_idx, year, month,
           coalesce(CAST(soil_snum = 1 AS DOUBLE), 0e0) AS soil_snum_1, coalesce(CAST(soil_snum = 2 AS DOUBLE), 0e0) AS soil_snum_2,
           coalesce(CAST(soil_snum = 3 AS DOUBLE), 0e0) AS soil_snum_3, coalesce(CAST(soil_snum = 4 AS DOUBLE), 0e0) AS soil_snum_4
    FROM tt"""), TRAINING_FIXTURES)
def q_one_hot(spark, sf_dir):
    """M-02: soil-class dummies over the categories of all rows, the lowest dropped."""
    d, names = M.one_hot(training(spark, sf_dir), "soil_snum")
    return d.select("pixel_idx", "year", "month", *names)


@register("m02_one_hot_sparse", """
    WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY l_partkey) - 2 AS BIGINT) AS slot, CAST(n AS DOUBLE) AS n_rows
    FROM c QUALIFY row_number() OVER (ORDER BY l_partkey) > 1""", ())
def q_one_hot_sparse(spark, sf_dir):
    """M-02 with a category for every part: the sparse vectors of all line items, added up by place."""
    li = fx.read_table(spark, sf_dir, "lineitem").select("l_partkey")
    encoded, _ = M.one_hot_sparse(li, "l_partkey")
    total = encoded.select(Summarizer.sum(F.col("l_partkey_onehot")).alias("v"))
    return total.select(F.posexplode(vector_to_array("v")).alias("slot", "n_rows")).select(F.col("slot").cast("long"), "n_rows")


@register("m03_impute_median", f"""
    WITH m AS (SELECT pixel_idx, t, year, CASE WHEN lst >= -100 THEN lst END AS lst,
                      CASE WHEN precip >= 0 THEN precip END AS precip FROM cells),
    med AS (SELECT median(lst) AS ml, median(precip) AS mp FROM m WHERE year <= 1999)
    SELECT pixel_idx, t, {rnd_sql('coalesce(lst, ml)')} AS lst, {rnd_sql('coalesce(precip, mp)')} AS precip
    FROM m, med""", ("cells",))
def q_impute_median(spark, sf_dir):
    """M-03: masked drivers filled with exact train-split medians."""
    from cellcube.operators.mask import mask_invalid

    c = mask_invalid(fx.cells(spark, sf_dir).select("pixel_idx", "t", "year", "lst", "precip"),
                     {"lst": "lst", "precip": "non_negative"})
    c = M.chrono_split(c, SPLIT.train_end, SPLIT.val_end)
    return round_doubles(M.impute_median(c, ["lst", "precip"]).select("pixel_idx", "t", "lst", "precip"))


SCALE_COLS = ["lst_driver_lag1", "log_precip_driver_lag1", "pop_density", "twi"]


@register("m04_standardize", WITH_TRAINING(f""",
    st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALE_COLS)} FROM tt WHERE year <= 1999)
    SELECT pixel_idx, year, month,
           {", ".join(f"{rnd_sql(f'(tt.{c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1e0 ELSE s_{c} END')} AS {c}" for c in SCALE_COLS)}
    FROM tt, st"""), TRAINING_FIXTURES)
def q_standardize(spark, sf_dir):
    """M-04: z-scores with train-split mean and population std (zero std -> 1)."""
    t = M.chrono_split(training(spark, sf_dir), SPLIT.train_end, SPLIT.val_end)
    return round_doubles(M.standardize(t, SCALE_COLS).select("pixel_idx", "year", "month", *SCALE_COLS))


@register("m05_standardize_static", f"""
    WITH st AS (SELECT avg(twi) AS m, stddev_pop(twi) AS s FROM static)
    SELECT pixel_idx, {rnd_sql('(twi - m) / CASE WHEN s = 0 THEN 1e0 ELSE s END')} AS twi FROM static, st""",
          ("static",))
def q_standardize_static(spark, sf_dir):
    """M-05: static TWI scaled over all cells."""
    return round_doubles(M.standardize_static(fx.static(spark, sf_dir), ["twi"]).select("pixel_idx", "twi"))


@register("m08_feature_list", WITH_TRAINING("""
    SELECT CAST(pos AS INTEGER) AS pos, feature FROM (
      SELECT pos, feature FROM (VALUES (0, 'lst_driver_lag1'), (1, 'lst_driver_lag2'), (2, 'lst_driver_lag3'),
        (3, 'log_precip_driver_lag1'), (4, 'log_precip_driver_lag2'), (5, 'log_precip_driver_lag3'),
        (6, 'pop_density'), (7, 'twi'), (8, 'month_sin'), (9, 'month_cos'), (10, 'year_trend'),
        (11, 'lst_x_precip'), (12, 'twi_x_precip'), (13, 'twi_x_lst')) v(pos, feature)
      UNION ALL
      SELECT 13 + row_number() OVER (ORDER BY soil_snum) AS pos, 'soil_snum_' || CAST(soil_snum AS VARCHAR) AS feature
      FROM (SELECT DISTINCT soil_snum FROM tt WHERE soil_snum > (SELECT min(soil_snum) FROM tt)) s) f"""),
          TRAINING_FIXTURES)
def q_feature_list(spark, sf_dir):
    """M-08: the baseline feature order derived from the prepared training table."""
    _, feats, _ = M.prepare_baseline(training(spark, sf_dir), SPLIT.train_end, SPLIT.val_end)
    return spark.createDataFrame([(i, f) for i, f in enumerate(feats)], "pos int, feature string")


@register("m15_time_series_folds", WITH_TRAINING("""
    , tr AS (SELECT year, month, pixel_idx, row_number() OVER (ORDER BY t, pixel_idx) - 1 AS pos,
                    count(*) OVER () AS n FROM tt WHERE year <= 1999)
    SELECT year, month, pixel_idx,
           CAST(CASE WHEN pos >= n - (n // 4) THEN 3 WHEN pos >= n - 2 * (n // 4) THEN 2
                     WHEN pos >= n - 3 * (n // 4) THEN 1 ELSE 0 END AS INTEGER) AS block
    FROM tr"""), TRAINING_FIXTURES)
def q_time_series_folds(spark, sf_dir):
    """M-15: expanding-window fold blocks (3 folds) by position in (month, cell)
    order over the train split; block 0 trains only."""
    t = training_stored(spark, sf_dir).where(F.col("year") <= SPLIT.train_end)
    t = t.withColumn("t", F.col("year") * 12 + F.col("month"))
    return M.time_series_folds(t, 3).select("year", "month", "pixel_idx", "block")


@register("a08_valid_counts", WITH_TRAINING(f""", {SQL_TS}
    SELECT {_split_sql('tt.year')} AS split, count(*) AS n_rows, count(DISTINCT ts.t_idx) AS n_timesteps,
           count(DISTINCT CASE WHEN ts.t_idx >= 12 THEN ts.t_idx END) AS n_windows
    FROM tt JOIN ts ON ts.year = tt.year AND ts.month = tt.month GROUP BY 1"""), TRAINING_FIXTURES)
def q_valid_counts(spark, sf_dir):
    """A-08: rows, timesteps and full-window timesteps per split."""
    t = training(spark, sf_dir)
    t = t.join(bounded_broadcast(N.timesteps(t, calendar=False), N.MAX_MONTHS), ["year", "month"])
    return A.valid_counts(M.chrono_split(t, SPLIT.train_end, SPLIT.val_end), "split", 12, "t_idx")
