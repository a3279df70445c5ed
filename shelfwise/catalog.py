"""Every question by name: ``CATALOG["kpi_fill_rate"](tables)`` gives a DataFrame (ranks store blocks while it is built)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .operators import audits, customer, dashboard, delivery, inventory, kpi, measures, sales
from .plans import views
from .sources.tables import Tables

Question = Callable[[Tables], DataFrame]

CATALOG: dict[str, Question] = {
    "kpi_fill_rate": kpi.fill_rate,
    "kpi_sla_by_store": kpi.sla_by_store,
    "kpi_inventory_turnover": kpi.inventory_turnover,
    "kpi_out_of_stock_rate": kpi.out_of_stock_rate,
    "kpi_revenue_lost_stockouts": kpi.revenue_lost_stockouts,
    "kpi_aov_by_store": kpi.aov_by_store,
    "kpi_repeat_customer_rate": kpi.repeat_customer_rate,
    "kpi_revenue_by_store": kpi.revenue_by_store_city,
    "kpi_revenue_by_city": kpi.revenue_by_city,
    "kpi_orders_by_place": kpi.orders_by_place,
    "kpi_cancellation_rate": kpi.cancellation_rate,
    "kpi_return_rate": kpi.return_rate,
    "sales_top_products": sales.top_products,
    "sales_category_share": sales.category_share,
    "sales_weekday_weekend": sales.weekday_weekend,
    "sales_monthly_mom": sales.monthly_mom,
    "sales_promo_effectiveness": sales.promo_effectiveness,
    "sales_best_seller_per_store": sales.best_seller_per_store,
    "sales_payment_mix": sales.payment_mix,
    "delivery_status_breakdown": delivery.status_breakdown,
    "delivery_delay_by_city": delivery.delay_by_city,
    "delivery_partner_scorecard": delivery.partner_scorecard,
    "delivery_percentiles_ntile": delivery.percentiles_ntile,
    "delivery_percentiles_exact": delivery.percentiles_exact,
    "delivery_bottleneck_stores": delivery.bottleneck_stores,
    "delivery_peak_hour": delivery.peak_hour,
    "delivery_vehicle_performance": delivery.vehicle_performance,
    "customer_frequency_segments": customer.frequency_segments,
    "customer_rfm": customer.rfm,
    "customer_order_gaps": customer.order_gaps,
    "customer_city_engagement": customer.city_engagement,
    "customer_new_vs_returning": customer.new_vs_returning,
    "customer_high_value": customer.high_value,
    "inventory_stockout_risk": inventory.stockout_risk,
    "inventory_wastage_top20": inventory.wastage_top,
    "inventory_wastage_rank": inventory.wastage_rank,
    "inventory_stock_movement": inventory.stock_movement,
    "inventory_rolling_avg": inventory.rolling_avg,
    "inventory_running_received": inventory.running_received,
    "inventory_demand_tiers": inventory.demand_tiers,
    "inventory_category_tree": inventory.category_tree,
    "view_store_daily_performance": views.store_daily_performance,
    "view_product_inventory_health": views.product_inventory_health,
    "mv_monthly_city_revenue": views.monthly_city_revenue_shown,
    "measure_total_revenue": dashboard.total_revenue,
    "measure_sla_pct": dashboard.sla,
    "measure_fill_rate": dashboard.fill_rate,
    "measure_cancellation_rate": dashboard.cancellation_rate,
    "measure_mom_growth": dashboard.mom_growth,
    "measures_by_context": measures.dashboard_measures,
    "measures_of_a_year": measures.measures_of_a_year,
    "dash_exec_kpis": dashboard.exec_kpis,
    "dash_revenue_by_category": dashboard.revenue_by_category,
    "dash_store_scorecard": dashboard.store_scorecard,
    "dash_store_matrix_by_city": dashboard.store_matrix_by_city,
    "dash_sla_by_city": dashboard.sla_by_city,
    "dash_low_stock": dashboard.low_stock,
    "dim_date": dashboard.dim_date,
    "sample_preview": dashboard.sample_preview,
    "audit_pk": audits.primary_keys,
    "audit_fk": audits.foreign_keys,
    "audit_unique": lambda t: audits.unique_keys(
        t.replaced(monthly_city_revenue=views.monthly_city_revenue(t))
    ),
    "audit_domain": audits.domains,
    "audit_range": audits.ranges,
    "audit_length": audits.text_lengths,
    "audit_not_null": audits.not_null,
    "audit_stock_balance": lambda t: audits.count_rule(audits.stock_balance(t), "stock balance", "inventory"),
    "audit_stock_continuity": lambda t: audits.count_rule(
        audits.stock_continuity(t), "stock continuity", "inventory"
    ),
    "audit_line_total": lambda t: audits.count_rule(audits.line_total(t), "line total", "order_items"),
    "audit_order_total": lambda t: audits.count_rule(audits.order_total(t), "order total", "orders"),
    "audit_delivery_status": lambda t: audits.count_rule(
        audits.delivery_status(t), "delivery status", "deliveries"
    ),
    "audit_delivery_clock": lambda t: audits.count_rule(audits.delivery_clock(t), "delivery clock", "deliveries"),
    "audit_payment": lambda t: audits.count_rule(audits.payment(t), "payment", "payments"),
    "audit_geography": audits.geography_count,
    "audit_returns": lambda t: audits.count_rule(audits.returns(t), "returns", "returns"),
    "audit_promo_window": audits.promo_window_count,
}
