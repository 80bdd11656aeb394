"""National sides: a small dimension by normalised name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side, code of its flag (None: it has none), country, colour.
NATIONAL_TEAMS = [
    ("india", "in", "India", "#1565c0"),
    ("australia", "au", "Australia", "#0b5d1e"),
    ("england", "gb-eng", "England", "#1f3a93"),
    ("pakistan", "pk", "Pakistan", "#01411c"),
    ("south africa", "za", "South Africa", "#007749"),
    ("new zealand", "nz", "New Zealand", "#000000"),
    ("sri lanka", "lk", "Sri Lanka", "#1b5e9b"),
    ("bangladesh", "bd", "Bangladesh", "#006a4e"),
    ("west indies", None, "West Indies", "#7b0000"),
    ("afghanistan", "af", "Afghanistan", "#d32011"),
    ("zimbabwe", "zw", "Zimbabwe", "#d40000"),
    ("ireland", "ie", "Ireland", "#169b62"),
    ("netherlands", "nl", "Netherlands", "#ff6f00"),
    ("scotland", "gb-sct", "Scotland", "#0065bf"),
    ("nepal", "np", "Nepal", "#dc143c"),
    ("united arab emirates", "ae", "United Arab Emirates", "#00732f"),
    ("oman", "om", "Oman", "#c8102e"),
    ("united states of america", "us", "United States", "#3c3b6e"),
    ("papua new guinea", "pg", "Papua New Guinea", "#c8102e"),
    ("namibia", "na", "Namibia", "#003580"),
    ("hong kong", "hk", "Hong Kong", "#de2910"),
    ("canada", "ca", "Canada", "#d52b1e"),
    ("kenya", "ke", "Kenya", "#006600"),
    ("bermuda", "bm", "Bermuda", "#00247d"),
    ("jersey", "je", "Jersey", "#cc0000"),
    ("guernsey", "gg", "Guernsey", "#cc0000"),
    ("italy", "it", "Italy", "#008c45"),
    ("germany", "de", "Germany", "#000000"),
    ("denmark", "dk", "Denmark", "#c8102e"),
    ("malaysia", "my", "Malaysia", "#010066"),
    ("singapore", "sg", "Singapore", "#ef3340"),
    ("uganda", "ug", "Uganda", "#000000"),
    ("qatar", "qa", "Qatar", "#8a1538"),
    ("kuwait", "kw", "Kuwait", "#007a3d"),
    ("bhutan", "bt", "Bhutan", "#ff4e12"),
    ("bahrain", "bh", "Bahrain", "#ce1126"),
    ("saudi arabia", "sa", "Saudi Arabia", "#006c35"),
    ("tanzania", "tz", "Tanzania", "#1eb53a"),
    ("nigeria", "ng", "Nigeria", "#008751"),
    ("botswana", "bw", "Botswana", "#75aadb"),
    ("mozambique", "mz", "Mozambique", "#007168"),
    ("rwanda", "rw", "Rwanda", "#00a1de"),
    ("mali", "ml", "Mali", "#14b53a"),
    ("france", "fr", "France", "#0055a4"),
    ("spain", "es", "Spain", "#aa151b"),
    ("portugal", "pt", "Portugal", "#006600"),
    ("austria", "at", "Austria", "#ed2939"),
    ("belgium", "be", "Belgium", "#000000"),
    ("norway", "no", "Norway", "#ba0c2f"),
    ("finland", "fi", "Finland", "#003580"),
    ("sweden", "se", "Sweden", "#006aa7"),
    ("czechia", "cz", "Czechia", "#11457e"),
    ("romania", "ro", "Romania", "#002b7f"),
    ("czech republic", "cz", "Czechia", "#11457e"),
    ("thailand", "th", "Thailand", "#a51931"),
    ("japan", "jp", "Japan", "#bc002d"),
    ("philippines", "ph", "Philippines", "#0038a8"),
    ("indonesia", "id", "Indonesia", "#ce1126"),
    ("fiji", "fj", "Fiji", "#62b5e5"),
    ("vanuatu", "vu", "Vanuatu", "#d21034"),
    ("samoa", "ws", "Samoa", "#002b7f"),
    ("cyprus", "cy", "Cyprus", "#d57800"),
    ("malta", "mt", "Malta", "#cf142b"),
    ("gibraltar", "gi", "Gibraltar", "#da000c"),
    ("ghana", "gh", "Ghana", "#006b3f"),
    ("greece", "gr", "Greece", "#0d5eaf"),
    ("hungary", "hu", "Hungary", "#436f4d"),
    ("israel", "il", "Israel", "#0038b8"),
    ("luxembourg", "lu", "Luxembourg", "#00a1de"),
    ("switzerland", "ch", "Switzerland", "#d52b1e"),
    ("turkey", "tr", "Turkey", "#e30a17"),
    ("isle of man", "im", "Isle of Man", "#cf142b"),
    ("cameroon", "cm", "Cameroon", "#007a5e"),
    ("eswatini", "sz", "Eswatini", "#3e5eb9"),
    ("seychelles", "sc", "Seychelles", "#d62828"),
    ("st helena", "sh", "St Helena", "#00247d"),
    ("mexico", "mx", "Mexico", "#006847"),
    ("argentina", "ar", "Argentina", "#74acdf"),
    ("brazil", "br", "Brazil", "#009c3b"),
    ("chile", "cl", "Chile", "#0039a6"),
    ("peru", "pe", "Peru", "#d91023"),
    ("panama", "pa", "Panama", "#005293"),
    ("costa rica", "cr", "Costa Rica", "#002b7f"),
    ("belize", "bz", "Belize", "#003f87"),
    ("cayman", "ky", "Cayman Islands", "#00247d"),
    ("cayman islands", "ky", "Cayman Islands", "#00247d"),
]


def national_teams(spark: SparkSession) -> DataFrame:
    """side, iso, country, color; one row a side."""
    return spark.createDataFrame(NATIONAL_TEAMS, "side string, iso string, country string, color string")


def flag_url(iso: Column, base: str) -> Column:
    """Address of a flag image of 320 pixels' width; null without a code."""
    return F.concat(F.lit(f"{base}/w320/"), iso, F.lit(".png"))
