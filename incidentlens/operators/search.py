"""Search, paging and row-level access. Filters reach the scan; a page is a top-k, not a full sort."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.operators.joins import logs_with_users, predictions_with_users, users_with_counts

SUMMARY = ["id", "created_at", "name_manufacturer", "classification", "risk_class", "prediction_label", "risk_score",
           "risk_percentage", "risk_level", "user_id"]


def _bounded(value, low, high, name):
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


def contains(df: DataFrame, term, *cols) -> DataFrame:
    """Case-insensitive search; ``%`` and ``_`` in the term act as wildcards, a backslash is plain."""
    if not term:
        return df
    pattern = "%" + term.replace("\\", "\\\\") + "%"
    cond = F.col(cols[0]).ilike(pattern)
    for c in cols[1:]:
        cond = cond | F.col(c).ilike(pattern)
    return df.filter(cond)


def _page(df, order, limit, offset):
    return df.orderBy(*order).offset(offset).limit(limit)


def _with_total(found, cols, page, limit, order):
    total = found.agg(F.count("*")).scalar()
    _bounded(page, 1, 2**31, "page")
    _bounded(limit, 1, 100, "limit")
    return _page(found.select(*cols), order, limit, (page - 1) * limit).withColumn("total", total)


def search_manufacturers(m: DataFrame, search=None, page: int = 1, limit: int = 20) -> DataFrame:
    return _with_total(contains(m, search, "name"), ["id", "name"], page, limit, ["name", "id"])


def search_devices(d: DataFrame, search=None, page: int = 1, limit: int = 20) -> DataFrame:
    found = contains(d.filter(F.col("name").isNotNull()), search, "name")
    return _with_total(found, ["id", "name", "classification"], page, limit, ["name", "id"])


def resort_by_time(df: DataFrame, ascending: bool) -> DataFrame:
    if ascending:
        return df.orderBy(F.asc("created_at"), F.asc("id"))
    return df.orderBy(F.desc("created_at"), F.desc("id"))


def _summary(p):
    return p.select(*[c for c in SUMMARY if c in p.columns])


def _filtered(p, search, risk_level, user_id=None):
    if user_id is not None:
        p = p.filter(F.col("user_id") == user_id)
    if risk_level:
        p = p.filter(F.col("risk_level") == risk_level.upper())
    return contains(p, search, "name_manufacturer", "classification", "type")


def _newest():
    return [F.desc("created_at"), F.desc("id")]


def prediction_history(p: DataFrame, user_id, search=None, risk_level=None, limit: int = 50, offset: int = 0,
                       ascending: bool = False) -> DataFrame:
    """One user's assessments: the newest page, shown newest or oldest first."""
    _bounded(limit, 1, 200, "limit")
    page = _page(_summary(_filtered(p, search, risk_level, user_id)), _newest(), limit, offset)
    return resort_by_time(page, True) if ascending else page


def prediction_detail(p: DataFrame, id, user_id, is_admin: bool) -> DataFrame:
    """One assessment; users who are not admins only see their own."""
    rows = p.filter(F.col("id") == id)
    return rows if is_admin else rows.filter(F.col("user_id") == user_id)


def admin_predictions(p: DataFrame, u: DataFrame, risk_level=None, user_id=None, search=None, limit: int = 100,
                      offset: int = 0) -> DataFrame:
    """All users' assessments. The page is cut first, so only its rows meet the user table."""
    _bounded(limit, 1, 500, "limit")
    page = _page(_summary(_filtered(p, search, risk_level, user_id)), _newest(), limit, offset)
    return predictions_with_users(page, u).orderBy(*_newest())


def admin_users(u: DataFrame, p: DataFrame, search=None, role=None, is_active=None, limit: int = 100,
                offset: int = 0) -> DataFrame:
    """Users with their assessment counts; only the page's users are counted."""
    _bounded(limit, 1, 500, "limit")
    if role:
        u = u.filter(F.col("role") == role.upper())
    if is_active is not None:
        u = u.filter(F.col("is_active") == is_active)
    found = contains(u, search, "full_name", "email")
    total = found.agg(F.count("*")).scalar()
    page = _page(found, _newest(), limit, offset)
    own = p.join(page.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return users_with_counts(page, own).withColumn("total", total).orderBy(*_newest())


def audit_trail(logs: DataFrame, u: DataFrame, action=None, limit: int = 100, offset: int = 0) -> DataFrame:
    _bounded(limit, 1, 500, "limit")
    if action:
        logs = logs.filter(F.col("action") == action.upper())
    return logs_with_users(_page(logs, _newest(), limit, offset), u).orderBy(*_newest())


def head_examples(df: DataFrame, by: str, n: int = 3, id_col: str = "id") -> DataFrame:
    """The first ``n`` rows of each class by id."""
    first = Window.partitionBy(by).orderBy(id_col)
    return (
        df.filter(F.col(by).isNotNull())
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= n)
        .drop("_rn")
        .orderBy(by, id_col)
    )
