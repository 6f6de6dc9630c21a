"""Columns that stand in for civic records on the driver's tables, as SQL text that both engines read alike."""

from __future__ import annotations

import datetime as dt

AS_OF = dt.date(2000, 1, 1)
AS_OF_SQL = "DATE '2000-01-01'"

ADDRESS = "concat(cast(c_custkey as string), '  ', c_mktsegment, ' ', case c_custkey % 4 when 0 then 'Street' when 1 then 'avenue' when 2 then 'BLVD' else 'Road' end)"
POSTAL = "concat('M', cast(c_custkey % 10 as string), case c_custkey % 3 when 0 then 'A' when 1 then 'B' else 'C' end)"
POSTAL_ADDRESS = f"concat({ADDRESS}, ' ', {POSTAL}, ' 1A', cast(c_custkey % 7 as string))"
COMPANY = "concat(c_name, case c_custkey % 5 when 0 then ' Inc.' when 1 then ' CO LTD' when 2 then ' Corporation' when 3 then ' #12' else '' end)"
LON = "(-79.4 + ((cast({k} as bigint) * 7919) % 10007) / cast(10007 as double) * 0.3)"
LAT = "(43.6 + ((cast({k} as bigint) * 104729) % 10009) / cast(10009 as double) * 0.2)"
CANCEL = "case when o_orderstatus = 'F' then cast(o_orderdate as date) + cast(o_orderkey % 400 as int) end"


def lon(key: str) -> str:
    return LON.format(k=key)


def lat(key: str) -> str:
    return LAT.format(k=key)
