"""The contract of match documents as a table of rules; schema, test and reasons are made from it.

A rule is a line: path | type | how | default. `[]` after a name goes into an array, `{}` into the values of a map. How:
`needed` (not null), `filled` (not blank), `least n`, `one of a,b`, `maybe` (anything of the type). A rule below an array
holds for each of its elements.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a document of the match archive must be like.
RULES = """
match_id | string | filled |
meta.revision | int | least 1 | 1
info | struct | needed |
info.match_type | string | maybe |
info.team_type | string | maybe |
info.gender | string | maybe |
info.season | string | maybe |
info.dates[] | string | needed |
info.event.name | string | maybe |
info.event.match_number | int | maybe |
info.venue | string | maybe |
info.city | string | maybe |
info.teams[] | string | needed |
info.toss.winner | string | maybe |
info.toss.decision | string | one of bat,field |
info.outcome.winner | string | maybe |
info.player_of_match[] | string | needed |
info.balls_per_over | int | least 1 | 6
info.players{}[] | string | needed |
info.registry.people{} | string | needed |
innings | array | needed |
innings[].team | string | filled | Unknown team
innings[].overs[].over | int | least 0 | 0
innings[].overs[].deliveries[].batter | string | filled | Unknown batter
innings[].overs[].deliveries[].bowler | string | filled | Unknown bowler
innings[].overs[].deliveries[].non_striker | string | maybe |
innings[].overs[].deliveries[].runs.batter | int | least 0 | 0
innings[].overs[].deliveries[].runs.extras | int | least 0 | 0
innings[].overs[].deliveries[].runs.total | int | least 0 | 0
innings[].overs[].deliveries[].extras{} | int | least 0 |
innings[].overs[].deliveries[].wickets[].kind | string | filled | unknown
innings[].overs[].deliveries[].wickets[].player_out | string | maybe |
innings[].overs[].deliveries[].wickets[].fielders[].name | string | maybe |
"""


class Rule(NamedTuple):
    path: str
    type: str
    how: str
    default: str | None

    @property
    def reason(self) -> str:
        return f"{self.path}: {'not ' + self.how if self.how.startswith('one of') else {'needed': 'missing', 'filled': 'blank'}.get(self.how, 'below ' + self.how.split(' ')[-1])}"


def rules(table: str = RULES) -> list[Rule]:
    out = []
    for line in table.strip().splitlines():
        path, kind, how, default = (x.strip() for x in line.split("|"))
        out.append(Rule(path, kind, how, default or None))
    return out


def _steps(path: str) -> list[str]:
    """info.players{}[] -> info, players, {}, []."""
    return path.replace("[]", ".[]").replace("{}", ".{}").split(".")


def schema(table: list[Rule]) -> str:
    """The columns that the rules speak of, as DDL."""
    tree: dict = {}
    for rule in table:
        node = tree
        for step in _steps(rule.path):
            node = node.setdefault(step, {})
        if not node:
            node[""] = rule.type

    def ddl(node: dict) -> str:
        if "[]" in node:
            return f"array<{ddl(node['[]'])}>"
        if "{}" in node:
            return f"map<string,{ddl(node['{}'])}>"
        fields = {k: v for k, v in node.items() if k}
        return f"struct<{','.join(f'{k}:{ddl(v)}' for k, v in fields.items())}>" if fields else node[""]

    return ", ".join(f"{k} {ddl(v)}" for k, v in tree.items())


def _breaks(rule: Rule, value: Column) -> Column:
    """Whether a value breaks the rule; where there is a default, a missing value is that."""
    value = value if rule.default is None else F.coalesce(value, F.lit(rule.default).cast(rule.type))
    how, _, rest = rule.how.partition(" ")
    if how == "needed":
        return value.isNull()
    if how == "filled":
        return F.trim(F.coalesce(value, F.lit(""))) == ""
    if how == "least":
        return F.coalesce(value < int(rest), F.lit(False))
    return F.coalesce(~F.lower(F.trim(value)).isin(rest.removeprefix("of ").split(",")) & (F.trim(value) != ""), F.lit(False))


def _broken(rule: Rule, value: Column, steps: list[str]) -> Column:
    if not steps:
        return _breaks(rule, value)
    step, rest = steps[0], steps[1:]
    inside = lambda x: _broken(rule, x, rest)
    if step == "[]":
        return F.coalesce(F.exists(value, inside), F.lit(False))
    if step == "{}":
        return F.coalesce(F.exists(F.map_values(value), inside), F.lit(False))
    return inside(value[step])


def reasons(table: list[Rule]) -> Column:
    """The reasons why a document breaks the rules, in their order."""
    found = []
    for rule in table:
        if rule.how != "maybe":
            first, *rest = _steps(rule.path)
            found.append(F.when(_broken(rule, F.col(first), rest), F.lit(rule.reason)))
    return F.array_compact(F.array(*found))


def split_by_rules(docs: DataFrame, table: list[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents that keep all rules, and (match_id, reasons) of the others; one that is not JSON says so alone."""
    table = table or rules()
    said = reasons(table)
    judged = docs.withColumn("reasons", F.when(F.col("broken").isNotNull(), F.array(F.lit("not JSON"))).otherwise(said) if "broken" in docs.columns else said)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0).select("match_id", "reasons")
