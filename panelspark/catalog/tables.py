"""Derived panel tables themselves, so that every later check rests on checked inputs."""

from panelspark.catalog.registry import query

query("table_bars", "asset d:d high:6 low:6 close:6 volume:2 value:4", "bars", "SELECT * FROM bars")(lambda s: s.bars())
query("table_index_bars", "index_id d:d close:6 volume:2", "idx", "SELECT * FROM idx")(lambda s: s.index_bars())
query("table_assets", "asset name exchange sector group_flag industry:i listed_shares:i", "assets", "SELECT * FROM assets")(lambda s: s.assets())
query("table_month_closes", "asset rd:d close:6", "mclose", "SELECT * FROM mclose")(lambda s: s.month_closes())
query("table_mcap", "asset snapshot_date:d market market_cap:0 listed_shares:i", "mcap", "SELECT * FROM mcap")(lambda s: s.mcap())
query("table_flow", "asset d:d foreign_net:2 inst_net:2 individual_net:2 holding_pct:6", "flow", "SELECT * FROM flow")(lambda s: s.flow())
query("table_investor_flow", "market d:d investor net:2", "invflow", "SELECT * FROM invflow")(lambda s: s.investor_flow())
query("table_fundamentals", "asset year:i reprt_code period_end:d rcept_dt:d revenue:2 operating_income:2 net_income:2 total_assets:2 total_equity:2 total_liabilities:2",
      "fund", "SELECT * FROM fund")(lambda s: s.fundamentals())
query("table_disclosures", "asset rcept_no rcept_dt:d event_category aqpln_prc_ostk:0 dppln_prc_ostk:0 bd_fta:0 nstk_ostk_qy:0 bdis_pric:2 ic_mthn div_mth bsis_stkqy:0 aft_stkqy:0 trade_uv:1 stkrt_irds:2",
      "disc", "SELECT * FROM disc")(lambda s: s.disclosures())
query("table_macro", "series obs_date:d value:10", "macro", "SELECT * FROM macro")(lambda s: s.macro())
query("table_themes", "theme asset", "themes", "SELECT * FROM themes")(lambda s: s.themes())
