"""The derived tables once more, as common table expressions for the comparison engine."""

VIEWS = {
    "series": """select cast(l_suppkey as bigint) as entity, cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month,
        cast(year(l_shipdate) * 12 + month(l_shipdate) - 1 as int) as month_ordinal, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as value
        from lineitem group by 1, 2, 3, 4""",
    "gappy": """select cast(o_custkey as bigint) as entity, cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month,
        cast(year(o_orderdate) * 12 + month(o_orderdate) - 1 as int) as month_ordinal, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value
        from orders group by 1, 2, 3, 4""",
    "info": """select s_suppkey as entity, s_acctbal as area, cast(s_suppkey * 37 % 1800 as double) / 10 - 90 as lat, cast(s_suppkey * 73 % 3600 as double) / 10 - 180 as lon,
        cast(s_nationkey % 3 + 1 as int) as kind, 10000000000 * (n_regionkey + 1) + 100000000 * cast(n_nationkey as bigint) + s_suppkey as code
        from supplier join nation on s_nationkey = n_nationkey""",
    "frozen": "select entity, month_ordinal from series where (entity + month_ordinal) % 17 < 2",
    "daily": "select user_id as entity, cast(ts as date) as day, value, event_type from events",
    "clim": "select *, avg(value) over (partition by entity, month) as climatology from series",
    "indexed": "select *, round(value - climatology, 9) as index_value from clim",
    "quants": "select entity, round(quantile_cont(index_value, 0.1), 9) as threshold_low, round(quantile_cont(index_value, 0.9), 9) as threshold_high from indexed group by entity",
    "labelled": """select i.*, threshold_low, threshold_high, case when index_value <= threshold_low then 'extreme_low' when index_value >= threshold_high then 'extreme_high' else 'normal' end as extreme_label
        from indexed i join quants using (entity)""",
    "extreme": """select entity, year, month, month_ordinal, case extreme_label when 'extreme_high' then 'high' else 'low' end as event_type, value, climatology, index_value,
        case extreme_label when 'extreme_high' then threshold_high else threshold_low end as threshold from labelled where extreme_label <> 'normal'""",
    "transition": """select entity, month_ordinal as from_ordinal, no as to_ordinal, case extreme_label when 'extreme_low' then 'low_to_high' else 'high_to_low' end as transition_type, index_value as from_index, ni as to_index
        from (select *, lead(month_ordinal) over w as no, lead(extreme_label) over w as nl, lead(index_value) over w as ni from labelled window w as (partition by entity order by month_ordinal))
        where no = month_ordinal + 1 and ((extreme_label = 'extreme_low' and nl = 'extreme_high') or (extreme_label = 'extreme_high' and nl = 'extreme_low'))""",
    "strong": """select *, case extreme_label when 'extreme_high' then index_value - threshold_high when 'extreme_low' then threshold_low - index_value else 0.0::double end as strength from labelled""",
    "weighted": """select *, coalesce(strength / nullif(avg(case when strength > 0 then strength end) over (partition by entity), 0), 0) as phi, month_ordinal - min(month_ordinal) over (partition by entity) as t from strong""",
    "decayed": """select * exclude (t), exp(-0.8 * t) * sum(phi * exp(0.8 * t)) over (partition by entity order by month_ordinal rows unbounded preceding) as decay_index from weighted""",
    "cells": "select entity, cast(floor(lon / 0.5) as bigint) as cell_x, cast(floor(lat / 0.5) as bigint) as cell_y from info",
    "wide_cells": "select entity, cast(floor(lon / 30) as bigint) as cell_x, cast(floor(lat / 30) as bigint) as cell_y from info",
    "fits": """select entity, tail, cast(q as decimal(5,4)) as threshold_quantile, (entity + k) % 5 <> 0 as converged, (entity + k) % 9 + 1 as n_extremes, n_observations,
        cast(entity % 11 as double) / 20 - 0.25 as xi, cast(entity % 13 + 1 as double) * 2 as sigma, case k when 0 then top else low end as threshold
        from (select entity, count(*) as n_observations, max(value) as top, min(value) as low from series group by entity),
        (values ('high', 0), ('low', 1)) t(tail, k), (values ('0.9500'), ('0.9800')) u(q)""",
    "status": "select entity, case when entity % 7 = 0 then 'error' else 'done' end as status, case when entity % 7 = 0 then 'failed for ' || entity end as error_message from info",
    "flagged": "select entity, cast(entity % 8 as int) as flags from info",
    "vcounts": "select entity, round(value, -3) as v, count(*) as n from series group by 1, 2",
    "years": "select entity, year, avg(value) as value from series group by 1, 2",
    "mates": "select entity, entity + 1 as partner from info where entity + 1 in (select entity from info)",
}


def sql(body: str, doubles: str = "", digits: int = 6) -> str:
    """The body over the views, its doubles rounded as results show them."""
    views = ", ".join(f"{name} as ({text})" for name, text in VIEWS.items())
    shown = ", ".join(f"round({c}, {digits}) + cast(0 as double) as {c}" for c in doubles.split())
    return f"with {views} select *{f' replace ({shown})' if shown else ''} from ({body})"
