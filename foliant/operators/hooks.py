"""Rules for pages of records, as columns and windows: checks of sums, canonical names, values that rows take from each other.

Each takes a table of records (a row each, fields as text columns), the columns of a page and those that order its rows.
Remarks go to a column, further ones behind a semicolon; a page never leaves its task, and no rule looks beyond a page.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money
from ..functions.text import is_absent, strip, value

# Fields and labels of the forms that these rules are for.
NOTE = "备注"
UNSEEN = "未见"
TOTALS = ("合计", "总计", "小计")


def _page(page: Sequence[str], order: Sequence[str] = ()) -> Window:
    w = Window.partitionBy(*page)
    return w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if order else w


def noted(old: Column | str, note: Column) -> Column:
    """A remark with another behind it; null adds none."""
    had = value(old)
    return F.when(note.isNull(), had).when(had == "", note).otherwise(F.concat(had, F.lit("；"), note))


def _money(cents: Column) -> Column:
    return (cents / 100).cast("decimal(38,2)").cast("string")


# ---- sums


def page_sums(records: DataFrame, page: Sequence[str], debit: str, credit: str, words: str, is_total: Column | None = None) -> DataFrame:
    """By page: debit and credit in cents, the amount in words in cents (`anchor`, null if there is none), whether the words
    conflict, and ok: debit equals credit and the words, where there are some, name just that. Total rows take no part;
    cells that hold no amount count as nothing."""
    rows = records if is_total is None else records.where(~is_total)
    # a page's different texts are read, not those of all its lines
    own = rows.groupBy(*page, F.when(F.col(words) != "", F.nullif(value(words), F.lit(""))).alias("_words")).agg(F.coalesce(F.sum(money.to_cents(debit)), F.lit(0)).alias("_d"), F.coalesce(F.sum(money.to_cents(credit)), F.lit(0)).alias("_c"))
    own = own.withColumn("_said", F.round(money.words_to_amount("_words") * 100, 0).cast("long"))
    found = own.groupBy(*page).agg(F.sum("_d").alias("debit"), F.sum("_c").alias("credit"), F.min("_said").alias("_low"), F.max("_said").alias("_high"))
    conflict = F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))
    anchor = F.when(~conflict, F.col("_low"))
    good = (F.col("debit") == F.col("credit")) & F.when(conflict, False).otherwise(F.coalesce(anchor == F.col("debit"), F.lit(True)))
    return found.select(*page, "debit", "credit", anchor.alias("anchor"), conflict.alias("conflict"), good.alias("ok"))


@dataclass(frozen=True)
class Voucher:
    """Fields of a voucher's lines. Fixed values."""

    debit: str = "借方金额"
    credit: str = "贷方金额"
    words: str = "合计大写"
    standard: str = "标准大写"
    account: str = "总账科目"
    note: str = NOTE


def balanced_vouchers(records: DataFrame, page: Sequence[str], order: Sequence[str], form: Voucher = Voucher()) -> DataFrame:
    """Lines with normalised amounts, the standard words of a page that balances, and a remark on one that doesn't add up.

    Words with digits or currency signs are a miscopied amount and are cleared. A page's one remark replaces what stood there.
    """
    out = records.withColumns({c: money.normalize_amount(c) for c in (form.debit, form.credit)})
    total = value(form.account) == "合计"
    w, ordered = _page(page), _page(page, order)
    cents = lambda c: F.coalesce(money.to_cents(c), F.lit(0))
    side = lambda c, of: F.sum(F.when(of, cents(c)).otherwise(0)).over(w)
    first = lambda c: F.first(F.when(value(c) != "", value(c)), ignorenulls=True).over(ordered)
    out = out.withColumns({"_d": side(form.debit, ~total), "_c": side(form.credit, ~total), "_td": side(form.debit, total), "_tc": side(form.credit, total), "_n": F.max(total.cast("int")).over(w), "_raw": first(form.words)})
    out = out.withColumn(form.words, F.when(value(form.words).rlike("(?U)[\\d￥¥]"), "").otherwise(F.coalesce(F.col(form.words), F.lit(""))))
    out = out.withColumn("_kept", first(form.words))
    even = F.col("_d") == F.col("_c")
    out = out.withColumn(form.standard, F.when(even & (F.col("_d") > 0), money.cents_in_words("_d")).otherwise(""))
    sums = F.concat(F.lit("借贷不平：借 "), _money(F.col("_d")), F.lit("，贷 "), _money(F.col("_c")), F.when(F.col("_n") == 1, F.concat(F.lit("（源表 "), _money(F.col("_td")), F.lit("/"), _money(F.col("_tc")), F.lit("）"))).otherwise(""), F.when(F.col("_kept").isNull(), "；大写无法确认").otherwise(""))
    out = out.withColumn("_says", F.round(money.words_to_amount("_kept") * 100, 0).cast("long"))
    blank = F.when(F.col("_raw").isNotNull(), "大写无法确认：原文含数字已清空").otherwise("大写无法确认：纸面空白或未识别")
    wrong = F.when((F.col(form.standard) != "") & (F.col("_says") != F.col("_d")), F.concat(F.lit("大写不符：原件「"), F.col("_kept"), F.lit("」应为「"), F.col(form.standard), F.lit("」")))
    note = F.when(~even, sums).when(F.col("_kept").isNull(), blank).otherwise(wrong)
    return out.withColumn(form.note, F.coalesce(note, F.col(form.note))).drop("_d", "_c", "_td", "_tc", "_n", "_raw", "_kept", "_says")


@dataclass(frozen=True)
class Audit:
    """Fields of an audit table's rows. Fixed values."""

    name: str = "项目名称"
    amounts: tuple[str, ...] = ("批复概算", "审计调整概算", "实际执行概算", "送审金额", "审计调整金额", "审定金额")
    submitted: str = "送审金额"
    adjusted: str = "审计调整金额"
    approved: str = "审定金额"
    note: str = NOTE


def is_total_row(name: Column | str) -> Column:
    v = value(name)
    return v.isin(*TOTALS) | ((F.length(v) <= 6) & v.endswith("合计"))


def _signed(x: Column) -> Column:
    text = x.cast("decimal(38,2)").cast("string")
    return F.when(x >= 0, F.concat(F.lit("+"), text)).otherwise(text)


def reconciled(records: DataFrame, page: Sequence[str], order: Sequence[str], form: Audit = Audit(), tolerance: float = 0.05) -> DataFrame:
    """Amounts with two decimals, and remarks: on a row of which the adjustment isn't the difference of what was submitted
    and approved (whatever their signs), and on a page's first total that isn't the sum of the other rows, column by column."""
    out = records.withColumns({c: money.cell_amount(c) for c in form.amounts})
    n = lambda c: F.col(c).try_cast("decimal(38,2)")
    off = F.abs(n(form.adjusted)) - F.abs(n(form.submitted) - n(form.approved))
    total, w = is_total_row(form.name), _page(page)
    first = F.row_number().over(Window.partitionBy(*page, total).orderBy(*order)) == 1
    notes = [F.when(F.abs(off) > tolerance, F.concat(F.lit("勾稽差"), _signed(off)))]
    out = out.withColumns({"_first": total & first, "_details": F.max((~total).cast("int")).over(w)})
    for c in (form.submitted, form.adjusted, form.approved):
        differs = n(c) - F.sum(F.when(~total, F.coalesce(n(c), F.lit(0)))).over(w)
        notes.append(F.when(F.col("_first") & (F.col("_details") == 1) & (F.abs(differs) > tolerance), F.concat(F.lit(f"合计{c}差"), _signed(differs))))
    out = out.withColumn("_notes", F.filter(F.array(*notes), lambda x: x.isNotNull()))
    return out.withColumn(form.note, noted(form.note, F.when(F.size("_notes") > 0, F.array_join("_notes", "；")))).drop("_first", "_details", "_notes")


# ---- names and blanks


def canonical(x: Column | str, known: Sequence[str], ladder: Sequence[tuple[str, Sequence[str]]], blank: str, other: str, fold: bool = False) -> Column:
    """A known name as it is; else the first step of which a keyword lies in the text, whatever its case (`=word`: is all
    of it); else `other`; blanks are `blank`. fold: names come out in capitals."""
    v = value(x)
    big = F.upper(v)
    out = F.when(v == "", blank).when((big if fold else v).isin(*known), big if fold else v)
    for name, words in ladder:
        hit = F.lit(False)
        for w in words:
            hit = hit | (big == w[1:].upper() if w.startswith("=") else F.contains(big, F.lit(w.upper())))
        out = out.when(hit, name)
    return out.otherwise(other)


# Kinds of records and of papers, by keywords in order.
RECORD_KINDS = ("单据头", "明细行", "往来方", "签章", "照片页")
RECORD_LADDER = (("明细行", ("明细", "item")), ("往来方", ("供应", "supplier")), ("签章", ("签", "sign", "chop")), ("照片页", ("照片", "photo")))
PAPER_KINDS = ("INVOICE", "PURCHASE ORDER", "QUOTATION", "WORK COMPLETION FORM", "PHOTO PAGE", "OTHER")
PAPER_LADDER = (("INVOICE", ("invoice",)), ("PURCHASE ORDER", ("purchase", "=po")), ("QUOTATION", ("quot",)), ("WORK COMPLETION FORM", ("completion", "wcf")), ("PHOTO PAGE", ("photo", "picture", "image")))
SEALS = ("无", "遮挡说明", "遮挡表格", "遮挡说明+遮挡表格")


def record_kind(x: Column | str) -> Column:
    return canonical(x, RECORD_KINDS, RECORD_LADDER, "单据头", "单据头")


def paper_kind(x: Column | str) -> Column:
    return canonical(x, PAPER_KINDS, PAPER_LADDER, "OTHER", "OTHER", fold=True)


def without_blanks(x: Column | str) -> Column:
    """Without any white space, the ideographic blank included."""
    return F.regexp_replace(x if isinstance(x, Column) else F.col(x), r"(?U)[\s\x1c-\x1f　]+", "")


def contract_kind(x: Column | str) -> Column:
    """One of two kinds of contracts; text that names neither stays."""
    bare = without_blanks(F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit("")))
    made = F.contains(bare, F.lit("产品")) | F.contains(bare, F.lit("加工"))
    return F.when(bare == "", value(x)).when(bare.isin("采购合同", "产品采购加工合同"), bare).when(made, "产品采购加工合同").when(F.contains(bare, F.lit("采购")), "采购合同").otherwise(value(x))


def seal(x: Column | str, gone: str = "遮挡图签") -> Column:
    """One of the allowed states, one that is no longer used taken out; others are `无`, blanks stay."""
    v = value(x)
    rest = F.array_join(F.filter(F.split(v, r"\+"), lambda p: p != gone), "+")
    v = F.when(F.contains(v, F.lit(gone)), F.when(rest == "", "无").otherwise(rest)).otherwise(v)
    return F.when(v == "", x if isinstance(x, Column) else F.col(x)).when(v.isin(*SEALS), v).otherwise("无")


def trimmed(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    return records.withColumns({c: strip(c) for c in fields})


def unseen_filled(records: DataFrame, fields: Sequence[str], mark: str = UNSEEN) -> DataFrame:
    """Blanks and nulls become the mark."""
    return records.withColumns({c: F.when(value(c) == "", mark).otherwise(F.col(c)) for c in fields})


def map_unseen_filled(data: Column | str, mark: str = UNSEEN) -> Column:
    """The same for a map of fields."""
    return F.transform_values(data, lambda _, v: F.when(value(v) == "", mark).otherwise(v))


def amounts_cleaned(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Currency signs and thousands marks go where a number remains."""
    return records.withColumns({c: money.clean_amount(c) for c in fields})


# ---- values from other rows of the page


def head_inherited(records: DataFrame, page: Sequence[str], order: Sequence[str], is_head: Column, fields: Sequence[str], unknown: dict[str, str] | None = None) -> DataFrame:
    """Blank and unseen fields (and those with the text that stands for unknown) take the value of the page's first head record."""
    w, out = _page(page, order), records
    for f in fields:
        none = is_absent(f, (UNSEEN,)) | (value(f) == (unknown or {}).get(f, ""))
        given = F.first(F.when(is_head, F.struct(value(f).alias("v"))), ignorenulls=True).over(w)["v"]
        known = ~given.isin("", UNSEEN, *(unknown or {}).values())
        out = out.withColumn(f, F.when(none & F.coalesce(known, F.lit(False)), given).otherwise(F.col(f)))
    return out


def first_spread(records: DataFrame, page: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Blank fields take the page's first value."""
    w = _page(page, order)
    return records.withColumns({f: F.when(value(f) != "", F.col(f)).otherwise(F.coalesce(F.first(F.when(value(f) != "", value(f)), ignorenulls=True).over(w), F.col(f))) for f in fields})


def mark_spread(records: DataFrame, page: Sequence[str], order: Sequence[str], is_head: Column, said: Column, to: Column, remark: str, note: str = NOTE) -> DataFrame:
    """A remark on the rows `to` of pages of which the first head record says so; not twice."""
    says = F.coalesce(F.first(F.when(is_head, F.struct(said.alias("v"))), ignorenulls=True).over(_page(page, order))["v"], F.lit(False))
    fresh = to & says & ~F.contains(value(note), F.lit(remark))
    return records.withColumn(note, F.when(fresh, noted(note, F.lit(remark))).otherwise(F.col(note)))


def title_stripped(body: Column | str, number: Column | str, name: Column | str, sep: str = "、") -> Column:
    """A text without the title that its own line begins with."""
    text = F.regexp_replace(F.coalesce(body if isinstance(body, Column) else F.col(body), F.lit("")), r"^\n+", "")
    head = strip(F.concat(value(number), F.lit(sep), value(name)))
    return F.when(text.startswith(head), F.regexp_replace(F.substring(text, F.length(head) + 1, F.length(text)), r"^\n+", "")).otherwise(body if isinstance(body, Column) else F.col(body))
