"""robots.txt: may an agent fetch a path, and how often?"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

AGENT = "webloom"
DEFAULT_DELAY_MS = 1000.0


def _lines(robots: Column, agent: str) -> Column:
    """Lines of the blocks of an agent; a block ends at an empty line."""
    blocks = F.regexp_extract_all(F.concat(F.lit("\n"), robots, F.lit("\n")), F.lit(r"\nUser-agent: " + re.escape(agent) + r"\n((?:[^\n]+\n)*)"), F.lit(1))
    return F.filter(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), lambda x: F.contains(x, F.lit(":")))


def _first_rule(robots: Column, path: Column, agent: str) -> Column:
    """Of the first rule whose value the path begins with: does it allow? Null if there is none."""
    value = lambda x: F.substring(x, F.locate(":", x) + 2, F.length(x))
    rules = F.filter(_lines(robots, agent), lambda x: (value(x) != "") & F.startswith(path, value(x)))
    return F.transform(F.slice(rules, 1, 1), lambda x: F.substring_index(x, ":", 1) != "Disallow")


def robots_allowed(robots: Column, path: Column, agent: str = AGENT) -> Column:
    """The agent's own rules decide; if none of them fits, those for ``*``; else the path is allowed. No robots.txt allows all."""
    own, every = _first_rule(robots, path, agent), _first_rule(robots, path, "*")
    return F.coalesce(F.get(F.concat(own, every), F.lit(0)), F.lit(True))


def robots_delay(robots: Column, agent: str = AGENT) -> Column:
    """Milliseconds between two requests to a host: the agent's Crawl-delay, else that for ``*``, else 1,000."""
    of = lambda a: F.filter(_lines(robots, a), lambda x: F.substring_index(x, ":", 1) == "Crawl-delay")
    first = F.get(F.concat(of(agent), of("*")), F.lit(0))
    return F.coalesce(F.substring(first, F.locate(":", first) + 1, F.length(first)).try_cast("double") * 1000, F.lit(DEFAULT_DELAY_MS))


def robots_rules(robots: str, agent: str = AGENT) -> tuple[list[tuple[str, str]], float]:
    """The same of one robots.txt, outside of Spark: ([(Allow or Disallow, path)] in the order in which they decide, milliseconds)."""
    rules, delays = [], []
    for name in (agent, "*"):
        for block in re.findall(r"\nUser-agent: " + re.escape(name) + r"\n((?:[^\n]+\n)*)", f"\n{robots}\n"):
            for line in block.splitlines():
                key, colon, value = line.partition(":")
                if colon and key == "Crawl-delay":
                    delays.append(value)
                elif colon and value[1:]:
                    rules.append(("Disallow" if key == "Disallow" else "Allow", value[1:]))
    try:
        return rules, float(delays[0]) * 1000 if delays else DEFAULT_DELAY_MS
    except ValueError:
        return rules, DEFAULT_DELAY_MS
