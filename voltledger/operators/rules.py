"""All validation rules in one registry, compiled into one pass over lines and one over bills.

A rule says in SQL what it finds of one row: a line, a meter, a bill, or each element of an array of the bill. The same rule
runs over a table of such rows (`found_in`), over arrays of a nested bill, and as counts that are added up before lines are
shuffled (`line_facts`), so a bill with very many lines is nowhere collected. Whole arrays are one expression each, which
keeps plans small."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dims
from .score import PENALTY_SQL, weight_sql
from .validate import MONEY, VAT_COUNTRIES, with_tolerance

ISSUE = "array<struct<rule_id:string,field:string,severity:string,expected:string,actual:string,weight:string>>"


@dataclass(frozen=True)
class Rule:
    """severity is SQL that gives null where there is no issue, field, expected and actual are what the issue says. In all of
    them {r} stands before a column of the row, {base} for the bill's tolerance; other names are the bill's. A rule of bills
    with over runs on each element of that array. gate names a boolean of the bill without which the rule doesn't run.
    levels are all severities that a rule of lines may give."""

    name: str
    on: str
    field: str
    severity: str
    expected: str
    actual: str
    gate: str = "true"
    over: str | None = None
    levels: tuple[str, ...] = ("warning",)

    def sql(self, of: str, r: str = "", base: str = "base") -> str:
        return getattr(self, of).format(r=r, base=base)

    def issue(self, r: str = "") -> str:
        """What the issue says is worked out only where there is one."""
        said = ", ".join(f"'{x}', cast({self.sql(x, r)} as string)" for x in ("expected", "actual"))
        found = f"named_struct('rule_id', '{self.name}', 'field', {self.sql('field', r)}, 'severity', {self.sql('severity', r)}, {said}, 'weight', {weight_sql(self.sql('field', r))})"
        return f"CASE WHEN {self.gate} AND ({self.sql('severity', r)}) IS NOT NULL THEN {found} END"


def _when(test: str, level: str = "warning") -> str:
    return f"CASE WHEN {test} THEN '{level}' END"


_HEAT = "({r}consumption_volume * coalesce({r}volume_correction_factor, 1.0D) * {r}calorific_value)"
#: The rules. Two of one name are two checks of that rule; callers may add to the list.
RULES = [
    Rule("V01", "lines", "concat('charges.', {r}line_number, '.amount')", "CASE WHEN abs({r}line_product - {r}amount) <= {base} THEN NULL WHEN {r}amount > {r}line_product AND {r}category = 'fixed' THEN 'info' WHEN abs({r}line_product - {r}amount) <= 0.02 * {r}amount THEN 'info' WHEN abs({r}line_product - {r}amount) > {base} THEN 'warning' END", "{r}line_product", "{r}amount", levels=("info", "warning")),
    Rule("V09", "lines", "concat('charges.', {r}line_number, '.amount')", _when("{r}amount < 0 AND NOT {r}category IN ('credit', 'adjustment')"), "'>=0'", "{r}amount"),
    Rule("V13", "lines", "concat('charges.', {r}line_number)", "CASE WHEN {r}reverse_charge THEN CASE WHEN {r}vat_amount <> 0 THEN 'warning' END WHEN abs({r}vat_due - {r}vat_amount) > 0.05 THEN 'error' END", "{r}vat_due", "{r}vat_amount", "under_vat", levels=("warning", "error")),
    Rule("V14", "lines", "concat('charges.', {r}line_number)", _when("abs({r}amount_net + {r}vat_amount - {r}amount_gross) > 0.05", "error"), f"cast({{r}}amount_net + {{r}}vat_amount as {MONEY})", "{r}amount_gross", "under_vat", levels=("error",)),
    Rule("V04", "meters", "'meters.consumption'", _when("abs(({r}current_read - {r}previous_read) * coalesce({r}multiplier, 1.0D) - {r}raw_value) > 1"), "({r}current_read - {r}previous_read) * coalesce({r}multiplier, 1.0D)", "{r}raw_value"),
    Rule("V05", "meters", "'meters.tou'", _when("abs({r}tou - {r}raw_value) > 1"), "{r}tou", "{r}raw_value"),
    Rule("V06", "meters", "'meters.unit'", _when("commodity_type = 'electricity' AND lower({r}raw_unit) IN ('therms', 'ccf', 'mcf', 'dekatherms')", "fatal"), "commodity_type", "{r}raw_unit"),
    Rule("V07", "meters", "'meters.unit'", _when("commodity_type = 'natural_gas' AND lower({r}raw_unit) IN ('kwh', 'kw')", "fatal"), "commodity_type", "{r}raw_unit", "in_us"),
    Rule("V18", "meters", "'meters.calorific_value'", _when("{r}calorific_value < 8 OR {r}calorific_value > 14"), "'8-14'", "{r}calorific_value", "is_gas"),
    Rule("V18", "meters", "'meters.volume_correction_factor'", _when("{r}volume_correction_factor <> 1 AND ({r}volume_correction_factor < 0.9 OR {r}volume_correction_factor > 1.1)"), "'0.9-1.1'", "{r}volume_correction_factor", "is_gas"),
    Rule("V19", "meters", "'meters.energy'", _when(f"{_HEAT} IS NOT NULL AND CASE WHEN {{r}}consumption_energy = 0 THEN true ELSE abs(try_divide({_HEAT} - {{r}}consumption_energy, {{r}}consumption_energy)) > 0.02 END", "error"), _HEAT, "{r}consumption_energy", "is_gas"),
    Rule("V02", "bills", "concat('totals.', {r}charge_section)", _when("abs({r}computed - {r}subtotal) > 2 * {base}"), "{r}computed", "{r}subtotal", over="sections"),
    Rule("V03", "bills", "'totals.current_charges'", "CASE WHEN abs({r}computed_total - {r}stated_total) > 4 * {base} THEN CASE WHEN {r}minimum_bill_applied THEN 'info' ELSE 'warning' END END", "{r}computed_total", "{r}stated_total"),
    Rule("V08", "bills", "'invoice.billing_days'", _when("{r}billing_days < 15 OR {r}billing_days > 95"), "'15-95'", "{r}billing_days"),
    Rule("V10", "bills", "'charges'", _when("{r}has_demand_charges AND NOT coalesce({r}has_demand_line, false)"), "'demand charge'", "'none'"),
    Rule("V11", "bills", "'meters.tou_breakdown'", _when("{r}has_tou AND NOT coalesce({r}any_tou, false)"), "'time-of-use rows'", "'none'"),
    Rule("V12", "bills", "'charges.charge_owner'", _when("{r}has_supplier_split AND coalesce({r}owners, 0) <= 1"), "'2'", "coalesce({r}owners, 0)"),
    Rule("V15", "bills", "concat('vat_summary.', {r}vat_rate)", _when("abs({r}base_sum - {r}stated_base) > 0.10"), "{r}base_sum", "{r}stated_base", "under_vat", "vat_summary"),
    Rule("V16", "bills", "concat('vat_summary.', {r}vat_rate)", _when("abs({r}vat_sum - {r}stated_vat) > 0.10"), "{r}vat_sum", "{r}stated_vat", "under_vat", "vat_summary"),
    Rule("V17", "bills", "'totals.total_gross'", _when("abs({r}total_net + {r}total_vat - {r}total_gross) > 0.05", "error"), f"cast({{r}}total_net + {{r}}total_vat as {MONEY})", "{r}total_gross", "under_vat"),
]


def _rules(on: str) -> list[Rule]:
    return [r for r in RULES if r.on == on]


def issues_of(on: str, over: str | None = None) -> Column:
    """Array of the issues that the rules on this kind of row find, each with the weight of its field. The row's columns stand beside base and the gates, or,
    with over, in the elements of that array."""
    each = [f"coalesce(transform({x}, r -> {one.issue('r.')}), cast(array() as {ISSUE}))" if (x := over or one.over) else f"array({one.issue()})" for one in _rules(on)]
    return F.expr(f"filter(concat({', '.join(each)}), i -> i IS NOT NULL)")


def with_gates(bills: DataFrame) -> DataFrame:
    """Adds the country's tolerance and what rules ask of a bill before they run; no country counts as US."""
    listed = ", ".join(f"'{c}'" for c in VAT_COUNTRIES)
    return with_tolerance(bills).selectExpr("*", f"coalesce(country_code, 'US') IN ({listed}) AS under_vat", "coalesce(country_code, 'US') = 'US' AS in_us", "coalesce(commodity_type = 'natural_gas', false) AS is_gas")


def with_products(lines: DataFrame) -> DataFrame:
    """Adds line_product (quantity times rate) and vat_due (net times rate, rates over 1 being percentages), in cents."""
    cents = lambda x: f"cast(round(cast({x} as decimal(38,8)), 2) as {MONEY})"
    return lines.selectExpr("*", f"{cents('quantity * rate')} AS line_product", f"{cents('amount_net * CASE WHEN vat_rate > 1 THEN vat_rate / 100 ELSE vat_rate END')} AS vat_due")


def found_in(rows: DataFrame, on: str, bills: DataFrame) -> DataFrame:
    """Issues of a table of lines or meters, one row each; bills as with_gates gives them."""
    gates = bills.select("extraction_id", "commodity_type", "base", "under_vat", "in_us", "is_gas")
    rows = with_products(rows) if on == "lines" else rows
    return rows.join(gates.hint("merge"), "extraction_id").select("extraction_id", F.inline(issues_of(on)))


def line_facts(lines: DataFrame, tolerances: list[str] | None = None) -> DataFrame:
    """What the rules need to know of a bill's lines, added up by bill, section and rate before anything is shuffled:
    computed_total, has_demand_line, owners (1, or 2 for more; a missing owner counts as one; told apart by 64-bit hashes, as
    strings would be sorted to be aggregated), cells (sums by section and
    rate, which are few) and tallies: how many issues of each severity a rule finds.

    A line doesn't know its bill's tolerance, so rules that look at it are counted for every tolerance there is (those of
    the country table and those given); the bill picks."""
    bases = sorted({base for _, base, _ in dims.TOLERANCES} | {dims.DEFAULT_TOLERANCE[0]} | set(tolerances or ()))
    judged_ = [(one, base) for one in _rules("lines") for base in (bases if "{base}" in one.severity else [None])]
    marked = with_products(lines).selectExpr("*", *(f"{one.sql('severity', base=f'cast({base} as decimal(4,2))')} AS _s{i}" for i, (one, base) in enumerate(judged_)))
    counted = [(one, base, level, f"_n{i}_{level}", f"count_if(_s{i} = '{level}') AS _n{i}_{level}") for i, (one, base) in enumerate(judged_) for level in one.levels]
    full = "amount_net IS NOT NULL AND vat_rate IS NOT NULL AND vat_amount IS NOT NULL"
    sums = [f"cast(sum(amount) as {MONEY}) AS amount", f"cast(sum(CASE WHEN {full} THEN amount_net END) as {MONEY}) AS net", f"cast(sum(CASE WHEN {full} THEN vat_amount END) as {MONEY}) AS vat"]
    cells = marked.groupBy("extraction_id", "charge_section", "vat_rate").agg(*map(F.expr, [*sums, "bool_or(category = 'demand') AS demand", "min(xxhash64(coalesce(charge_owner, '?'))) AS first_owner", "max(xxhash64(coalesce(charge_owner, '?'))) AS last_owner", *(c[4] for c in counted)]))
    tally = ", ".join(f"named_struct('rule_id', '{one.name}', 'base', cast({base or 'NULL'} as decimal(4,2)), 'vat', {str(one.gate != 'true').lower()}, 'severity', '{level}', 'n', sum({n}))" for one, base, level, n, _ in counted)
    return cells.groupBy("extraction_id").agg(*map(F.expr, [
        f"cast(sum(amount) as {MONEY}) AS computed_total", "bool_or(demand) AS has_demand_line", "CASE WHEN min(first_owner) = max(last_owner) THEN 1 ELSE 2 END AS owners",
        "collect_list(named_struct('charge_section', charge_section, 'vat_rate', vat_rate, 'amount', amount, 'net', net, 'vat', vat)) AS cells", f"array({tally}) AS tallies",
    ]))


def added(of: str, key: str, value: str) -> str:
    """SQL of the sum of a bill's cells of that key; null without one that has a value."""
    kind = "decimal(28,2)"
    return f"cast(aggregate(cells, cast(NULL as {kind}), (a, c) -> CASE WHEN c.{key} = {value} THEN coalesce(cast(a + c.{of} as {kind}), cast(c.{of} as {kind}), a) ELSE a END) as {MONEY})"


def with_computed(bills: DataFrame) -> DataFrame:
    """Puts the sums of cells beside what the bill states: sections (charge_section, subtotal) get computed, vat_summary
    (vat_rate, stated_base, stated_vat) gets base_sum and vat_sum. What has no lines isn't checked."""
    return bills.withColumns({
        "sections": F.expr(f"transform(sections, s -> named_struct('charge_section', s.charge_section, 'subtotal', s.subtotal, 'computed', {added('amount', 'charge_section', 's.charge_section')}))"),
        "vat_summary": F.expr(f"transform(vat_summary, v -> named_struct('vat_rate', v.vat_rate, 'stated_base', v.stated_base, 'stated_vat', v.stated_vat, 'base_sum', {added('net', 'vat_rate', 'v.vat_rate')}, 'vat_sum', {added('vat', 'vat_rate', 'v.vat_rate')}))"),
    })


def judged(nested: DataFrame) -> DataFrame:
    """Nested bills (with_gates, line facts, with_computed, an array of meters) with issues (of the bill and its meters, one by one),
    n_issues, n_fatal, n_error, n_warning (those of lines included), and of all that cost something cost, deadly (whether one of
    them is in a field of fatal weight) and labels (their rules, in order). An issue costs what its field's weight costs; the
    number in a line's path doesn't tell its weight."""
    by_rule = ", ".join(f"'{one.name}', {weight_sql(one.sql('field').replace('line_number', '0'))}" for one in _rules("lines"))
    of_lines = f"transform(filter(coalesce(tallies, array()), t -> t.n > 0 AND coalesce(t.base = base, true) AND (under_vat OR NOT t.vat)), t -> named_struct('rule_id', t.rule_id, 'severity', t.severity, 'weight', element_at(map({by_rule}), t.rule_id), 'n', t.n))"
    single = "transform(issues, i -> named_struct('rule_id', i.rule_id, 'severity', i.severity, 'weight', i.weight, 'n', 1L))"
    total = lambda test, what="i.n", start="0L", kind="bigint": f"aggregate(_all, cast({start} as {kind}), (a, i) -> CASE WHEN {test} THEN cast(a + {what} as {kind}) ELSE a END)"
    rows = nested.withColumn("issues", F.concat(issues_of("bills"), issues_of("meters", "meters"))).withColumn("_all", F.expr(f"concat({single}, {of_lines})"))
    return rows.selectExpr(
        "* except (_all)", f"{total('true')} AS n_issues", *(f"""{total(f"i.severity = '{x}'")} AS n_{x}""" for x in ("fatal", "error", "warning")), f"""{total("i.severity <> 'info'", f"i.n * element_at({PENALTY_SQL}, i.weight)", "0", "decimal(18,4)")} AS cost""",
        "exists(_all, i -> i.severity <> 'info' AND i.weight = 'fatal') AS deadly", "array_sort(array_distinct(transform(filter(_all, i -> i.severity <> 'info'), i -> i.rule_id))) AS labels",
    )


def disposition(strict: bool = False) -> Column:
    """Of a judged bill: discrepancy with a fatal issue (strict: or an error), else rounding_variance with a warning, else clean."""
    worst = F.col("n_fatal") + F.col("n_error") if strict else F.col("n_fatal")
    return F.when(worst > 0, "discrepancy").when(F.col("n_warning") > 0, "rounding_variance").otherwise("clean")


def all_issues(bills: DataFrame, lines: DataFrame, meters: DataFrame) -> DataFrame:
    """Every issue of every rule, one row each: bills nested but for their meters (with_gates, line facts, with_computed,
    any_tou), lines, and meters with tou, the sum of their periods."""
    of_bills = bills.select("extraction_id", F.inline(issues_of("bills")))
    return of_bills.unionByName(found_in(lines, "lines", bills)).unionByName(found_in(meters, "meters", bills))
