"""Fixed tables of rules and vocabularies, and the rewrite of patterns to Java's dialect."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word boundary between ASCII word characters, as the patterns mean it; Java's ``\\b`` also sees accented letters.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def java(pattern: str, ignore_case: bool = True) -> str:
    """A pattern of the tables for Spark: ASCII word boundaries, and only line feeds as line ends."""
    return ("(?id)" if ignore_case else "(?d)") + re.sub(r"(?<!\\)((?:\\\\)*)\\b", lambda m: m[1] + BOUNDARY, pattern)


#: Letters, digits and marks beyond ASCII: no word characters to the patterns, but to Java's ``\\b``.
OTHER_LETTERS = r"[[^\x00-\x7F]&&[\p{L}\p{N}\p{M}]]"


def plain_words(text: Column) -> Column:
    """The text with other letters replaced by a sign, so that Java's ``\\b``, far cheaper than BOUNDARY, is the patterns' word boundary; counts and lengths stay."""
    return F.regexp_replace(text, OTHER_LETTERS, "¤")


def count_in(plain: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Matches of a pattern of the tables in a text of ``plain_words``."""
    return F.regexp_count(plain, F.lit(("(?id)" if ignore_case else "(?d)") + pattern))


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_count(text, F.lit(java(pattern, ignore_case)))


def _alternatives(pattern: str) -> list[str]:
    """The pattern's top-level alternatives."""
    parts, depth, at, last = [], 0, 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and not depth:
            parts.append(pattern[last:at])
            last = at + 1
        at += 1
    return [*parts, pattern[last:]]


def _runs(pattern: str) -> list[str]:
    """Literal runs that every match of a pattern without top-level alternatives contains, outside its groups."""
    bare = re.sub(r"\\.", " ", pattern.replace("\\.", "\x00").replace(r"\|", "\x01"))
    while (less := re.sub(r"\([^()]*\)[?*]?(?:\{[^}]*\})?|\[[^\]]*\]", " ", bare)) != bare:
        bare = less
    bare = re.sub(r".[?*]|\{[^}]*\}", " ", bare.replace("\x00", "."))
    return re.findall(r"[a-z]{2,}|\d\.\d", bare) or ["|"] * ("\x01" in bare)


def needed_words(pattern: str) -> list[str] | None:
    """A literal run that every match of each alternative contains; None where there is none.

    Where an alternative has none outside its groups, those of a group that it can't do without serve.
    """
    words = []
    for alternative in _alternatives(pattern):
        runs = _runs(alternative)
        if runs:
            words.append(max(runs, key=len))
            continue
        inner = next((x for g in re.findall(r"\((?:\?:)?([^()]*(?:\([^()]*\)[^()]*)*)\)(?![?*])", alternative) if (x := needed_words(g))), None)
        if inner is None:
            return None
        words += inner
    return sorted(set(words))


def leading_words(pattern: str) -> list[str] | None:
    """Strings of two signs or more, or digits, with one of which every match begins; None where a match can begin otherwise. Digits and classes of letters are spelled out."""
    words = []
    for alternative in _alternatives(pattern):
        rest, made = alternative.removeprefix(r"\b"), [""]
        while unit := re.match(r"[a-z0-9]|\\\.|\\d|\[[a-z]+\]", rest):
            signs = "0123456789" if unit[0] == r"\d" else unit[0][-1] if len(unit[0]) < 3 else unit[0][1:-1]
            after = rest[unit.end() : unit.end() + 1]
            if after in ("?", "*", "{") or len(made) * len(signs) > 32:
                break
            made, rest = [w + c for w in made for c in signs], rest[unit.end() :]
            if after == "+":
                break
        if all(len(w) >= 2 or w.isdigit() for w in made):
            words += made
            continue
        group = re.match(r"\((?:\?:)?([^()]*(?:\([^()]*\)[^()]*)*)\)(?![?*{])", rest)
        if made != [""] or not group or (inner := leading_words(group[1])) is None:
            return None
        words += inner
    return sorted(set(words))


def _tree(words: list[str]) -> str:
    """A pattern of the longest of the words at a place, letter by letter, so that few letters are looked at where none stands."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    body = "|".join(re.escape(c) + (_tree(rest) if rest != [""] else "") for c, rest in sorted(heads.items()))
    return f"(?:{body}){'?' if '' in words else ''}"


@functools.lru_cache(maxsize=4)
def _keyword_pattern(patterns: tuple[str, ...]) -> str:
    return f"(?=({_tree(sorted({w for p in patterns for w in needed_words(p) or ()}))}))"


def keywords(lower: Column, patterns: Iterable[str]) -> Column:
    """The keywords of the patterns that a text in small letters contains, each after a bar; one reading of the text for all of them.

    Where two begin at one place the longer one stands for both, as ``may_match`` looks for beginnings.
    """
    found = F.array_distinct(F.regexp_extract_all(lower, F.lit(_keyword_pattern(tuple(patterns))), F.lit(1)))
    return F.concat(F.lit("/"), F.array_join(found, "/"))


def may_match(known: Column, pattern: str) -> Column | None:
    """Whether the text with these ``keywords`` has one that every match of the pattern contains; None for a pattern without keywords."""
    words = needed_words(pattern)
    return None if words is None else functools.reduce(lambda a, b: a | b, [known.contains(f"/{w}") for w in words])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, columns: dict[str, Column], condition: Column | str | None = None) -> DataFrame:
    """``df`` with costly columns, filtered on them, each evaluated once a row.

    A filter on a projection is otherwise pushed below it, with a copy of the expressions; a row number in
    the same projection keeps it above.
    """
    rows = df.withColumns({**columns, "_row": F.monotonically_increasing_id()})
    test = F.expr(condition) if isinstance(condition, str) else F.lit(True) if condition is None else condition
    return rows.where(test & (F.col("_row") >= 0)).drop("_row")


def has(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(java(pattern, ignore_case))


# The disclosure rules (frameworks, materiality, governance, climate, targets, environment,
# social, assurance, quality). All ignore case but data_tables, which has no letters.
RULES: dict[str, str] = {
    "framework_esrs": r"\besrs\b",
    "framework_csrd": r"\bcsrd\b",
    "framework_efrag": r"\befrag\b",
    "framework_gri": r"\bgri\b",
    "framework_sasb": r"\bsasb\b",
    "framework_tcfd": r"\btcfd\b",
    "framework_issb": r"\bissb\b",
    "framework_ifrs_s1": r"\bifrs\s*s\s*1\b",
    "framework_ifrs_s2": r"\bifrs\s*s\s*2\b",
    "framework_eu_taxonomy": r"\beu\s+taxonomy\b|\btaxonomy\s+regulation\b|\btaxonomy[\s-]+aligned\b|\btaxonomy[\s-]+eligible\b",
    "framework_tnfd": r"\btnfd\b",
    "framework_cdp": r"\bcdp\b",
    "framework_sdgs": r"\bsdgs?\b|\bsustainable\s+development\s+goals?\b",
    "paris_agreement": r"\bparis\s+agreement\b|\b1\.5\s*°?\s*c\b|\b1\.5\s*degrees?\b|\bwell[\s-]+below\s+2\s*°?\s*c\b",
    "gri_content_index": r"\bgri\s+content\s+index\b|\bgri\s+standards?\s+index\b|\bgri\s+\d{3}",
    "double_materiality": r"\bdouble\s+materiality\b",
    "materiality_assessment": r"\bmateriality\b",
    "value_chain": r"\bvalue\s+chain\b",
    "supply_chain": r"\bsupply\s+chain\b",
    "materiality_matrix": r"\bmateriality\s+matrix\b|\bmateriality\s+assessment\s+process\b|\bstakeholder\s+prioriti[sz]ation\b|\bimpact\s+materiality\b|\bfinancial\s+materiality\b",
    "iro_analysis": r"\biro\b|\bimpact[\s,]+risk[\s,]+opportunit",
    "board_oversight": r"\bboard\s+of\s+directors\b|\bboard\s+oversight\b|\bboard\s+level\s+(?:oversight|responsibility|governance)\b",
    "audit_committee": r"\baudit\s+committee\b",
    "internal_control": r"\binternal\s+control(s)?\b|\bcontrol\s+system\b|\bcontrols\s+over\s+sustainability\s+reporting\b|\binternal\s+audit\b",
    "risk_management": r"\brisk\s+management\b",
    "esg_remuneration": r"\besg[\s-]+linked\s+remuner|\bsustainability[\s-]+linked\s+remuner|\bcompensation[^.]{0,40}sustainability|\bremuner[^.]{0,40}\besg\b|\bvariable\s+pay[^.]{0,30}sustainability|\bkpi[^.]{0,30}sustainab",
    "whistleblower": r"\bwhistleblow(er|ing)\b|\bspeak[\s-]*up\b|\bgrievance\s+mechanism\b|\bethics\s+hotline\b|\breporting\s+channel\b",
    "anti_corruption": r"\banti[\s-]*corruption\b|\banti[\s-]*bribery\b|\bbribery\b|\bcorruption\b",
    "data_privacy": r"\bdata\s+priva(cy|te)\b|\bgdpr\b|\bcyber[\s-]*security\b|\bdata\s+protect(ion)?\b|\binformation\s+security\b",
    "tax_transparency": r"\btax\s+transparency\b|\bcountry[\s-]+by[\s-]+country\s+report",
    "sustainability_committee": r"\bsustainability\s+committee\b|\besg\s+committee\b|\bcsr\s+committee\b|\bresponsible\s+business\s+committee\b",
    "scope_1": r"\bscope\s*1\b",
    "scope_2": r"\bscope\s*2\b",
    "scope_3": r"\bscope\s*3\b",
    "ghg_protocol": r"\bghg\s+protocol\b",
    "tco2e_units": r"\btco\s*2\s*e\b|\bco\s*2\s*e\b|\btonnes?\s+(?:of\s+)?co\s*2\b|\bmt\s*co\s*2",
    "emissions_intensity": r"\bemissions?\s+intensity\b|\bcarbon\s+intensity\b|\bco2e?\s+per\b|\bgrams?\s+(?:of\s+)?co2",
    "base_year": r"\bbase\s+year\b|\bbaseline\s+year\b",
    "scope2_method": r"\blocation[\s-]+based\b|\bmarket[\s-]+based\b",
    "emissions_numbers": r"\b\d[\d,.\s]*\s*(?:tco2e?|mt\s*co2|tonnes?\s+(?:of\s+)?co2|kg\s*co2)",
    "net_zero": r"\bnet\s*-?\s*zero\b",
    "sbti": r"\bsbti\b|\bscience[\s-]+based\s+targets?\b",
    "transition_plan": r"\btransition\s+plan\b|\bclimate\s+transition\b|\bdecarboni[zs]ation\s+(?:plan|pathway|roadmap|strateg)",
    "targets": r"\btarget(s)?\b",
    "quantitative_targets": r"\b(?:target|goal|objective|commit(?:ment|ted)?)\b[^.]{0,120}\b(?:20[2-9]\d|203\d)\b",
    "interim_targets": r"\binterim\s+target\b|\bshort[\s-]+term\s+target\b|\b20(?:25|26|27|28|29|30)\s+target\b|\bmilestone",
    "target_progress": r"\bprogress\s+(?:towards?|against|on)\s+(?:our\s+)?targets?\b|\bachieved\s+\d+\s*%|\bon\s+track\b|\bahead\s+of\s+target",
    "climate_scenario": r"\bclimate\s+scenario\b|\bscenario\s+analysis\b|\bphysical\s+risk\b|\btransition\s+risk\b|\brcp\s*\d|\bssp\s*\d|\biea\s+(?:nze|sds|aps)",
    "carbon_pricing": r"\bcarbon\s+pric(e|ing)\b|\binternal\s+carbon\s+pric(e|ing)\b|\bcarbon\s+offset(s|ting)?\b|\bcarbon\s+credit(s)?\b|\bets\b",
    "energy": r"\benergy\s+consumption\b|\bmwh\b|\bkwh\b|\bgj\b|\benergy\s+intensity\b|\benergy\s+efficienc",
    "water": r"\bwater\s+(?:consumption|withdrawal|usage|intensity|stress|recycl|reuse)\b|\bwater\s+risk\b",
    "waste": r"\bwaste\s+(?:generation|diversion|recycl|management|disposal|reduc)\b|\bcircular\s+economy\b|\bwaste\s+to\s+landfill",
    "renewable_energy": r"\brenewable\s+energy\b|\brenewable\s+electricity\b|\bppa\b|\bpower\s+purchase\s+agreement\b|\bgreen\s+electricity\b",
    "biodiversity": r"\bbiodiversity\b|\bnature[\s-]+positive\b|\bnature[\s-]+related\b|\becosystem(s)?\s+(service|loss|restoration)\b|\bdeforestation\b|\bno[\s-]+net[\s-]+loss\b",
    "circular_economy": r"\bcircular\s+economy\b|\bcircularity\b|\bcircular\s+design\b|\bproduct\s+lifecycle\b",
    "pollution": r"\bpollut(ion|ant)\b|\bair\s+quality\b|\bnox\b|\bsox\b|\bvoc\b|\bparticulate\b",
    "workforce": r"\bworkforce\b|\bemployees?\b|\bheadcount\b|\bfte\b|\bfull[\s-]+time\s+equivalent",
    "safety": r"\bltir\b|\btrir\b|\binjury\b|\bsafety\b|\baccident(s)?\b|\bfatalit(y|ies)\b|\blost[\s-]+time\b|\brecordable\b",
    "diversity": r"\bdiversity\b|\bequal\s+opportunit(y|ies)\b|\bgender\b|\binclusion\b|\bdi&i\b|\bdei\b|\bgender\s+pay\s+gap\b",
    "human_rights": r"\bhuman\s+rights\b|\bdue\s+diligence\b|\bforced\s+labou?r\b|\bchild\s+labou?r\b|\bmodern\s+slavery\b",
    "training": r"\btraining\s+hours?\b|\bcapacity\s+building\b|\blearning\s+and\s+development\b|\bskills?\s+development\b|\btraining\s+per\s+employee\b",
    "stakeholder_engagement": r"\bstakeholder\s+engagement\b|\bstakeholder\s+dialogue\b|\bstakeholder\s+consultation\b|\bstakeholder\s+input\b|\bstakeholder\s+mapping\b",
    "community_investment": r"\bcommunity\s+invest(ment|ing)\b|\bsocial\s+invest(ment|ing)\b|\bphilanthropy\b|\bcommunity\s+engagement\b|\bvolunteer",
    "living_wage": r"\bliving\s+wage\b|\bfair\s+wage\b|\bliving\s+income\b",
    "just_transition": r"\bjust\s+transition\b",
    "health_wellbeing": r"\bhealth\s+(?:and|&)\s+(?:well[\s-]*being|wellness)\b|\bmental\s+health\b|\bemployee\s+wellbeing\b|\boccupational\s+health\b",
    "employee_turnover": r"\bturnover\s+rate\b|\bemployee\s+retention\b|\battrition\b|\bvoluntary\s+turnover\b",
    "assurance_any": r"\blimited\s+assurance\b|\breasonable\s+assurance\b|\bindependent\s+assurance\b|\bassurance\b|\bverification\b|\bindependent\s+verif",
    "assurance_limited": r"\blimited\s+assurance\b",
    "assurance_reasonable": r"\breasonable\s+assurance\b",
    "assurance_isae": r"\bisae\s*3000\b|\bisae\s*3410\b",
    "assurance_aa1000": r"\baa\s*1000\b",
    "assurance_negative": r"\bno\s+assurance\b|\bnot\s+assured\b|\bunaudited\b",
    "assurance_scope": r"\bassurance\s+(?:covers?|scope|over|of)[^.]{0,80}(?:scope\s*[123]|ghg|emissions|energy|water|waste|social|environment)",
    "named_assurance_provider": r"\b(?:deloitte|kpmg|pwc|pricewaterhousecoopers|ernst\s*&\s*young|ey\b|bureau\s+veritas|sgs\b|dnv\b|lrqa\b|mazars\b|bdo\b|grant\s+thornton\b|moore\b)",
    "methodology": r"\bmethodolog(y|ies)\b|\bcalculation\s+method\b|\bmeasurement\s+approach\b",
    "boundary": r"\borganizational\s+boundary\b|\boperational\s+boundary\b|\breporting\s+scope\b|\bconsolidation\s+scope\b|\breporting\s+boundary",
    "limitations": r"\blimitation(s)?\b|\bdata\s+gap(s)?\b|\bestimat(ed|es|ion)\b|\bdata\s+not\s+available\b|\bpartial\s+data\b|\bdata\s+qualit(y|ies)\b",
    "restatement": r"\brestat(ed|ement)\b|\brecalculated\b|\brevised\s+(?:data|figure|metric)\b|\bcorrect(ed|ion)\s+(?:to|of)",
    "forward_looking": r"\bforward[\s-]+looking\b|\boutlook\b|\bfuture\s+plan(s)?\b|\broadmap\b|\baction\s+plan\b|\bambition(s)?\b|\bstrateg(y|ic)\s+(?:plan|direction|priorit)",
    "reporting_period": r"\breporting\s+period\b|\bfiscal\s+year\b|\bfinancial\s+year\b|\b(?:january|1\s+january).*(?:december|31\s+december)\b|\bcalendar\s+year\b",
    "data_tables": r"\|[^|]+\|[^|]+\|",
    "data_quality": r"\bdata\s+quality\b|\bdata\s+governance\b|\bdata\s+validation\b|\bdata\s+verification\b|\bdata\s+collection\s+(?:process|method)",
    "connectivity_financial": r"\bconnect(?:ed|ivity|ion)\s+(?:with|to|between)\s+(?:financial|annual)\b|\bintegrat(?:ed|ion)\s+(?:with|into)\s+(?:financial|annual)\b|\bfinancial\s+(?:impact|implication|effect)\b",
    "esrs_datapoints": r"\besrs\s+[es]\d\b|\b[es]\d[\s-]+\d+\b|\besrs\s+\d\b|\bdr\s+[es]\d",
    "sector_specific": r"\bsector[\s-]+specific\b|\bindustry[\s-]+specific\b|\bsector\s+standard\b",
}

# The rule made of four patterns. Found by the first, else by the second; depth counts the
# third, pages count the fourth.
SCOPE3_RULE = "scope3_categories"
SCOPE3_PATTERNS = (
    r"\bcategory\s+\d{1,2}\b[^.]{0,80}(?:scope\s*3|upstream|downstream|purchased|capital|fuel|transport|business\s+travel|commut|waste|leased|franchis|investment)",
    r"(?:scope\s*3|upstream|downstream)[^.]{0,80}\bcategory\s+\d{1,2}\b",
    r"\bcategory\s+\d{1,2}\b[^.]{0,80}(?:scope\s*3|upstream|downstream)",
    r"\bcategory\s+\d{1,2}\b",
)

# Quotes kept for a rule.
QUOTES_DEFAULT = 3
QUOTES = {"quantitative_targets": 4, "assurance_any": 4, "data_tables": 2}

#: All rule keys, the composite rule in its place after scope2_method.
RULE_KEYS = [k for key in RULES for k in ((key, SCOPE3_RULE) if key == "scope2_method" else (key,))]
