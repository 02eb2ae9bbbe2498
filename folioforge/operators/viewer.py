"""Capability rules over captured response headers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def framing(responses: DataFrame) -> DataFrame:
    """id, iframe and reason from status, headers (lower-case keys) and error."""
    header = lambda h: F.lower(F.coalesce(F.element_at("headers", h), F.lit("")))
    xfo, csp = header("x-frame-options"), header("content-security-policy")
    refused = xfo.contains("deny") | xfo.contains("sameorigin")
    fenced = csp.contains("frame-ancestors") & ~csp.contains("*")
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("unreachable: "), F.col("error")))
        .when(~F.col("status").eqNullSafe(200), F.concat(F.lit("probe returned "), F.coalesce(F.col("status").cast("string"), F.lit("nothing"))))
        .when(refused, F.concat(F.lit("x-frame-options: "), xfo))
        .when(fenced, "csp frame-ancestors")
        .otherwise("no framing restriction")
    )
    return responses.select("id", reason.alias("reason")).withColumn("iframe", F.col("reason") == "no framing restriction")


def viewer(iframe: Column, proxy: Column) -> Column:
    """How to show an item: framed, through the proxy, or as a link."""
    return F.when(iframe, "framed").when(proxy, "proxied").otherwise("link")


class Capabilities:
    """Framing verdicts, each asked for once per process: ``probe`` gives the responses of an id."""

    def __init__(self, probe: Callable[[int], DataFrame]):
        self.probe, self.known = probe, {}

    def of(self, id: int) -> tuple[bool, str]:
        if id not in self.known:
            row = framing(self.probe(id)).first()
            self.known[id] = (row.iframe, row.reason) if row else (False, "probe returned nothing")
        return self.known[id]
