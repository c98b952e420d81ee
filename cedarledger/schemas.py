"""Types of the data model. Money carries eight decimals; sums are widened by Spark."""

from pyspark.sql import types as T

FORMULA_VERSION = "v1"
MONEY = T.DecimalType(20, 8)

SOURCE = T.StructType([
    T.StructField("source_name", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("retrieved_at", T.TimestampType()),
    T.StructField("checksum", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("field_path", T.StringType()),
])

# Names of elements in the regulator's asset-level XML, and the columns they fill.
LOAN_STRINGS = {
    "asset_number": "assetNumber", "group_id": "GroupID", "originator_name": "originatorName",
    "payment_status_code": "paymentStatusLoanCode"
}
LOAN_DATES = {
    "origination_date": "originationDate", "maturity_date": "maturityDate", "paid_through_date": "paidThroughDate",
    "period_beginning_date": "reportingPeriodBeginningDate", "period_ending_date": "reportingPeriodEndDate",
}
LOAN_AMOUNTS = {
    "original_loan_amount": "originalLoanAmount", "original_interest_rate_percentage": "originalInterestRatePercentage",
    "scheduled_principal_amount": "scheduledPrincipalAmount", "scheduled_interest_amount": "scheduledInterestAmount",
    "actual_balance_amount": "reportPeriodEndActualBalanceAmount", "scheduled_balance_amount": "reportPeriodEndScheduledLoanBalanceAmount",
}
PROPERTY_STRINGS = {
    "property_name": "propertyName", "address": "propertyAddress", "city": "propertyCity", "state": "propertyState", "zip": "propertyZip",
    "county": "propertyCounty", "property_type_code": "propertyTypeCode",
}
PROPERTY_INTS = {"year_built": "yearBuiltNumber"}
PROPERTY_AMOUNTS = {"net_rentable_square_feet": "netRentableSquareFeetNumber"}
SECURITIZATION_DATES = {"valuation_date": "valuationSecuritizationDate"}
SECURITIZATION_AMOUNTS = {
    "valuation_amount": "valuationSecuritizationAmount", "physical_occupancy_percentage": "physicalOccupancySecuritizationPercentage",
    "net_rentable_square_feet": "netRentableSquareFeetSecuritizationNumber", "revenue_amount": "revenueSecuritizationAmount",
    "operating_expenses_amount": "operatingExpensesSecuritizationAmount", "net_operating_income_amount": "netOperatingIncomeSecuritizationAmount",
    "net_cash_flow_amount": "netCashFlowFlowSecuritizationAmount",
}
RECENT_DATES = {
    "financials_start_date": "mostRecentFinancialsStartDate", "financials_end_date": "mostRecentFinancialsEndDate"
}
RECENT_AMOUNTS = {
    "revenue_amount": "mostRecentRevenueAmount", "operating_expenses_amount": "operatingExpensesAmount",
    "net_operating_income_amount": "mostRecentNetOperatingIncomeAmount", "net_cash_flow_amount": "mostRecentNetCashFlowAmount",
    "debt_service_amount": "mostRecentDebtServiceAmount", "physical_occupancy_percentage": "mostRecentPhysicalOccupancyPercentage",
    "dscr_noi_percentage": "mostRecentDebtServiceCoverageNetOperatingIncomePercentage", "dscr_ncf_percentage": "mostRecentDebtServiceCoverageNetCashFlowpercentage",
}
ADVANCES = "totalPrincipalInterestAdvancedOutstandingAmount"
CURRENT = "0"
