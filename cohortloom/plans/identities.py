"""Accounting identities of the financial statements: equations between columns, whose terms sum to zero."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Identity:
    name: str
    section: str
    kind: str
    terms: tuple[tuple[str, float], ...]
    form: str = "990"

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(v for v, _ in self.terms)


# The equations of each form and section, one a line: name, kind, equation.
F990_REVENUE = """
rev_grand_columns: column: F9_08_REV_TOT_TOT = F9_08_REV_TOT_RLTD + F9_08_REV_TOT_UBIZ + F9_08_REV_TOT_EXCL
rev_prog_columns: column: F9_08_REV_PROG_OTH_TOT = F9_08_REV_PROG_OTH_RLTD + F9_08_REV_PROG_OTH_UBIZ + F9_08_REV_PROG_OTH_EXCL
rev_misc_columns: column: F9_08_REV_MISC_OTH_TOT = F9_08_REV_MISC_OTH_RLTD + F9_08_REV_MISC_OTH_UBIZ + F9_08_REV_MISC_OTH_EXCL
rev_invest_columns: column: F9_08_REV_OTH_INVEST_INCOME_TOT = F9_08_REV_OTH_INVEST_INCOME_RLTD + F9_08_REV_OTH_INVEST_INCOME_UBIZ + F9_08_REV_OTH_INVEST_INCOME_EXCL
rev_bond_columns: column: F9_08_REV_OTH_INVEST_BOND_TOT = F9_08_REV_OTH_INVEST_BOND_RLTD + F9_08_REV_OTH_INVEST_BOND_UBIZ + F9_08_REV_OTH_INVEST_BOND_EXCL
rev_royalty_columns: column: F9_08_REV_OTH_ROY_TOT = F9_08_REV_OTH_ROY_RLTD + F9_08_REV_OTH_ROY_UBIZ + F9_08_REV_OTH_ROY_EXCL
rev_rent_columns: column: F9_08_REV_OTH_RENT_NET_TOT = F9_08_REV_OTH_RENT_NET_RLTD + F9_08_REV_OTH_RENT_NET_UBIZ + F9_08_REV_OTH_RENT_NET_EXCL
rev_sales_columns: column: F9_08_REV_OTH_SALE_GAIN_NET_TOT = F9_08_REV_OTH_SALE_GAIN_NET_RLTD + F9_08_REV_OTH_SALE_GAIN_NET_UBIZ + F9_08_REV_OTH_SALE_GAIN_NET_EXCL
rev_fundr_columns: column: F9_08_REV_OTH_FUNDR_NET_TOT = F9_08_REV_OTH_FUNDR_NET_RLTD + F9_08_REV_OTH_FUNDR_NET_UBIZ + F9_08_REV_OTH_FUNDR_NET_EXCL
rev_gaming_columns: column: F9_08_REV_OTH_GAMING_NET_TOT = F9_08_REV_OTH_GAMING_NET_RLTD + F9_08_REV_OTH_GAMING_NET_UBIZ + F9_08_REV_OTH_GAMING_NET_EXCL
rev_inventory_columns: column: F9_08_REV_OTH_INV_NET_TOT = F9_08_REV_OTH_INV_NET_RLTD + F9_08_REV_OTH_INV_NET_UBIZ + F9_08_REV_OTH_INV_NET_EXCL
rev_contributions_subtotal: subtotal: F9_08_REV_CONTR_TOT = F9_08_REV_CONTR_FED_CAMP + F9_08_REV_CONTR_MEMBSHIP_DUE + F9_08_REV_CONTR_FUNDR_EVNT + F9_08_REV_CONTR_RLTD_ORG + F9_08_REV_CONTR_GOVT_GRANT + F9_08_REV_CONTR_OTH
rev_rent_income_real: net: F9_08_REV_OTH_RENT_INCOME_REAL = F9_08_REV_OTH_RENT_GRO_REAL - F9_08_REV_OTH_RENT_LESS_EXP_REAL
rev_rent_income_pers: net: F9_08_REV_OTH_RENT_INCOME_PERS = F9_08_REV_OTH_RENT_GRO_PERS - F9_08_REV_OTH_RENT_LESS_EXP_PERS
rev_rent_net: subtotal: F9_08_REV_OTH_RENT_NET_TOT = F9_08_REV_OTH_RENT_INCOME_REAL + F9_08_REV_OTH_RENT_INCOME_PERS
rev_sale_gain_sec: net: F9_08_REV_OTH_SALE_GAIN_SEC = F9_08_REV_OTH_SALE_ASSET_SEC - F9_08_REV_OTH_SALE_LESS_COST_SEC
rev_sale_gain_oth: net: F9_08_REV_OTH_SALE_GAIN_OTH = F9_08_REV_OTH_SALE_ASSET_OTH - F9_08_REV_OTH_SALE_LESS_COST_OTH
rev_sale_net: subtotal: F9_08_REV_OTH_SALE_GAIN_NET_TOT = F9_08_REV_OTH_SALE_GAIN_SEC + F9_08_REV_OTH_SALE_GAIN_OTH
rev_gaming_net: net: F9_08_REV_OTH_GAMING_NET_TOT = F9_08_REV_OTH_GAMING - F9_08_REV_OTH_GAMING_DIRECT_EXP
rev_inventory_net: net: F9_08_REV_OTH_INV_NET_TOT = F9_08_REV_OTH_INV_GRO_SALE - F9_08_REV_OTH_INV_COST_GOODS
rev_grand_total: grand_total: F9_08_REV_TOT_TOT = F9_08_REV_CONTR_TOT + F9_08_REV_PROG_TOT_TOT + F9_08_REV_OTH_INVEST_INCOME_TOT + F9_08_REV_OTH_INVEST_BOND_TOT + F9_08_REV_OTH_ROY_TOT + F9_08_REV_OTH_RENT_NET_TOT + F9_08_REV_OTH_SALE_GAIN_NET_TOT + F9_08_REV_OTH_FUNDR_NET_TOT + F9_08_REV_OTH_GAMING_NET_TOT + F9_08_REV_OTH_INV_NET_TOT + F9_08_REV_MISC_TOT_TOT
"""
F990_EXPENSES = """
exp_ad_promo_columns: column: F9_09_EXP_AD_PROMO_TOT = F9_09_EXP_AD_PROMO_PROG + F9_09_EXP_AD_PROMO_MGMT + F9_09_EXP_AD_PROMO_FUNDR
exp_comp_dsq_pers_columns: column: F9_09_EXP_COMP_DSQ_PERS_TOT = F9_09_EXP_COMP_DSQ_PERS_PROG + F9_09_EXP_COMP_DSQ_PERS_MGMT + F9_09_EXP_COMP_DSQ_PERS_FUNDR
exp_comp_dtk_columns: column: F9_09_EXP_COMP_DTK_TOT = F9_09_EXP_COMP_DTK_PROG + F9_09_EXP_COMP_DTK_MGMT + F9_09_EXP_COMP_DTK_FUNDR
exp_conf_meeting_columns: column: F9_09_EXP_CONF_MEETING_TOT = F9_09_EXP_CONF_MEETING_PROG + F9_09_EXP_CONF_MEETING_MGMT + F9_09_EXP_CONF_MEETING_FUNDR
exp_deprec_columns: column: F9_09_EXP_DEPREC_TOT = F9_09_EXP_DEPREC_PROG + F9_09_EXP_DEPREC_MGMT + F9_09_EXP_DEPREC_FUNDR
exp_fee_svc_acc_columns: column: F9_09_EXP_FEE_SVC_ACC_TOT = F9_09_EXP_FEE_SVC_ACC_PROG + F9_09_EXP_FEE_SVC_ACC_MGMT + F9_09_EXP_FEE_SVC_ACC_FUNDR
exp_fee_svc_invest_columns: column: F9_09_EXP_FEE_SVC_INVEST_TOT = F9_09_EXP_FEE_SVC_INVEST_PROG + F9_09_EXP_FEE_SVC_INVEST_MGMT + F9_09_EXP_FEE_SVC_INVEST_FUNDR
exp_fee_svc_legal_columns: column: F9_09_EXP_FEE_SVC_LEGAL_TOT = F9_09_EXP_FEE_SVC_LEGAL_PROG + F9_09_EXP_FEE_SVC_LEGAL_MGMT + F9_09_EXP_FEE_SVC_LEGAL_FUNDR
exp_fee_svc_lob_columns: column: F9_09_EXP_FEE_SVC_LOB_TOT = F9_09_EXP_FEE_SVC_LOB_PROG + F9_09_EXP_FEE_SVC_LOB_MGMT + F9_09_EXP_FEE_SVC_LOB_FUNDR
exp_fee_svc_mgmt_columns: column: F9_09_EXP_FEE_SVC_MGMT_TOT = F9_09_EXP_FEE_SVC_MGMT_PROG + F9_09_EXP_FEE_SVC_MGMT_MGMT + F9_09_EXP_FEE_SVC_MGMT_FUNDR
exp_fee_svc_oth_columns: column: F9_09_EXP_FEE_SVC_OTH_TOT = F9_09_EXP_FEE_SVC_OTH_PROG + F9_09_EXP_FEE_SVC_OTH_MGMT + F9_09_EXP_FEE_SVC_OTH_FUNDR
exp_info_tech_columns: column: F9_09_EXP_INFO_TECH_TOT = F9_09_EXP_INFO_TECH_PROG + F9_09_EXP_INFO_TECH_MGMT + F9_09_EXP_INFO_TECH_FUNDR
exp_insurance_columns: column: F9_09_EXP_INSURANCE_TOT = F9_09_EXP_INSURANCE_PROG + F9_09_EXP_INSURANCE_MGMT + F9_09_EXP_INSURANCE_FUNDR
exp_int_columns: column: F9_09_EXP_INT_TOT = F9_09_EXP_INT_PROG + F9_09_EXP_INT_MGMT + F9_09_EXP_INT_FUNDR
exp_joint_cost_columns: column: F9_09_EXP_JOINT_COST_TOT = F9_09_EXP_JOINT_COST_PROG + F9_09_EXP_JOINT_COST_MGMT + F9_09_EXP_JOINT_COST_FUNDR
exp_occupancy_columns: column: F9_09_EXP_OCCUPANCY_TOT = F9_09_EXP_OCCUPANCY_PROG + F9_09_EXP_OCCUPANCY_MGMT + F9_09_EXP_OCCUPANCY_FUNDR
exp_office_columns: column: F9_09_EXP_OFFICE_TOT = F9_09_EXP_OFFICE_PROG + F9_09_EXP_OFFICE_MGMT + F9_09_EXP_OFFICE_FUNDR
exp_oth_empl_ben_columns: column: F9_09_EXP_OTH_EMPL_BEN_TOT = F9_09_EXP_OTH_EMPL_BEN_PROG + F9_09_EXP_OTH_EMPL_BEN_MGMT + F9_09_EXP_OTH_EMPL_BEN_FUNDR
exp_oth_oth_columns: column: F9_09_EXP_OTH_OTH_TOT = F9_09_EXP_OTH_OTH_PROG + F9_09_EXP_OTH_OTH_MGMT + F9_09_EXP_OTH_OTH_FUNDR
exp_oth_sal_wage_columns: column: F9_09_EXP_OTH_SAL_WAGE_TOT = F9_09_EXP_OTH_SAL_WAGE_PROG + F9_09_EXP_OTH_SAL_WAGE_MGMT + F9_09_EXP_OTH_SAL_WAGE_FUNDR
exp_pay_affil_columns: column: F9_09_EXP_PAY_AFFIL_TOT = F9_09_EXP_PAY_AFFIL_PROG + F9_09_EXP_PAY_AFFIL_MGMT + F9_09_EXP_PAY_AFFIL_FUNDR
exp_payroll_tax_columns: column: F9_09_EXP_PAYROLL_TAX_TOT = F9_09_EXP_PAYROLL_TAX_PROG + F9_09_EXP_PAYROLL_TAX_MGMT + F9_09_EXP_PAYROLL_TAX_FUNDR
exp_pension_contr_columns: column: F9_09_EXP_PENSION_CONTR_TOT = F9_09_EXP_PENSION_CONTR_PROG + F9_09_EXP_PENSION_CONTR_MGMT + F9_09_EXP_PENSION_CONTR_FUNDR
exp_roy_columns: column: F9_09_EXP_ROY_TOT = F9_09_EXP_ROY_PROG + F9_09_EXP_ROY_MGMT + F9_09_EXP_ROY_FUNDR
exp_travel_columns: column: F9_09_EXP_TRAVEL_TOT = F9_09_EXP_TRAVEL_PROG + F9_09_EXP_TRAVEL_MGMT + F9_09_EXP_TRAVEL_FUNDR
exp_travel_entmt_columns: column: F9_09_EXP_TRAVEL_ENTMT_TOT = F9_09_EXP_TRAVEL_ENTMT_PROG + F9_09_EXP_TRAVEL_ENTMT_MGMT + F9_09_EXP_TRAVEL_ENTMT_FUNDR
exp_ben_paid_memb_columns: column: F9_09_EXP_BEN_PAID_MEMB_TOT = F9_09_EXP_BEN_PAID_MEMB_PROG
exp_grant_frgn_columns: column: F9_09_EXP_GRANT_FRGN_TOT = F9_09_EXP_GRANT_FRGN_PROG
exp_grant_us_indiv_columns: column: F9_09_EXP_GRANT_US_INDIV_TOT = F9_09_EXP_GRANT_US_INDIV_PROG
exp_grant_us_org_columns: column: F9_09_EXP_GRANT_US_ORG_TOT = F9_09_EXP_GRANT_US_ORG_PROG
exp_fee_svc_fundr_columns: column: F9_09_EXP_FEE_SVC_FUNDR_TOT = F9_09_EXP_FEE_SVC_FUNDR_FUNDR
exp_grand_columns: grand_total: F9_09_EXP_TOT_TOT = F9_09_EXP_TOT_PROG + F9_09_EXP_TOT_MGMT + F9_09_EXP_TOT_FUNDR
"""
F990_BALANCE_SHEET = """
bs_balance_boy: balance: F9_10_ASSET_TOT_BOY = F9_10_LIAB_TOT_BOY + F9_10_NAFB_TOT_BOY
bs_liabilities_boy: subtotal: F9_10_LIAB_TOT_BOY = F9_10_LIAB_ACC_PAYABLE_BOY + F9_10_LIAB_GRANT_PAYABLE_BOY + F9_10_LIAB_REV_DEFERRED_BOY + F9_10_LIAB_TAX_EXEMPT_BOND_BOY + F9_10_LIAB_ESCROW_ACC_BOY + F9_10_LIAB_LOAN_OFF_BOY + F9_10_LIAB_MTG_NOTE_BOY + F9_10_LIAB_NOTE_UNSEC_BOY + F9_10_LIAB_OTH_BOY
bs_balance_eoy: balance: F9_10_ASSET_TOT_EOY = F9_10_LIAB_TOT_EOY + F9_10_NAFB_TOT_EOY
bs_liabilities_eoy: subtotal: F9_10_LIAB_TOT_EOY = F9_10_LIAB_ACC_PAYABLE_EOY + F9_10_LIAB_GRANT_PAYABLE_EOY + F9_10_LIAB_REV_DEFERRED_EOY + F9_10_LIAB_TAX_EXEMPT_BOND_EOY + F9_10_LIAB_ESCROW_ACC_EOY + F9_10_LIAB_LOAN_OFF_EOY + F9_10_LIAB_MTG_NOTE_EOY + F9_10_LIAB_NOTE_UNSEC_EOY + F9_10_LIAB_OTH_EOY
bs_land_bldg_net: net: F9_10_ASSET_LAND_BLDG_NET_EOY = F9_10_ASSET_LAND_BLDG - F9_10_ASSET_LAND_BLDG_DEPREC
"""
PF_REVENUE = """
pf_rev_total_books: subtotal: PF_01_REV_TOT_BOOKS = PF_01_REV_CONTR_REC_BOOKS + PF_01_REV_INT_SAVING_BOOKS + PF_01_REV_DIVIDEND_BOOKS + PF_01_REV_RENT_GRO_BOOKS + PF_01_REV_SALE_ASSET_NET_BOOKS + PF_01_REV_GRO_PROFIT_BOOKS + PF_01_REV_OTH_INCOME_BOOKS
pf_rev_total_net: subtotal: PF_01_REV_TOT_NET = PF_01_REV_INT_SAVING_NET + PF_01_REV_DIVIDEND_NET + PF_01_REV_RENT_GRO_NET + PF_01_REV_CAP_GAIN_NET + PF_01_REV_OTH_INCOME_NET
pf_rev_total_adj_net: subtotal: PF_01_REV_TOT_ADJ_NET = PF_01_REV_INT_SAVING_ADJ_NET + PF_01_REV_DIVIDEND_ADJ_NET + PF_01_REV_RENT_GRO_ADJ_NET + PF_01_REV_CAP_GAIN_ADJ_NET + PF_01_REV_INCOME_MOD_ADJ_NET + PF_01_REV_GRO_PROFIT_ADJ_NET + PF_01_REV_OTH_INCOME_ADJ_NET
pf_rev_gross_profit: net: PF_01_REV_GRO_PROFIT_BOOKS = PF_01_REV_GRO_SALE_LESS_RETURN - PF_01_REV_LESS_COST_GOODS_SOLD
pf_excess_rev_over_exp: net: PF_01_EXCESS_REV_OVER_EXP_BOOKS = PF_01_REV_TOT_BOOKS - PF_01_EXP_TOT_EXP_DISBMT_BOOKS
"""
PF_EXPENSES = """
pf_exp_operating_books: subtotal: PF_01_EXP_TOT_OPERATING_BOOKS = PF_01_EXP_COMP_OFF_BOOKS + PF_01_EXP_OTH_EMPL_SAL_BOOKS + PF_01_EXP_PENSION_EMPL_BOOKS + PF_01_EXP_LEGAL_BEN_BOOKS + PF_01_EXP_ACC_FEE_BOOKS + PF_01_EXP_OTH_PROF_FEE_BOOKS + PF_01_EXP_INT_BOOKS + PF_01_EXP_TAXES_BOOKS + PF_01_EXP_DEPREC_BOOKS + PF_01_EXP_OCCUPANCY_BOOKS + PF_01_EXP_TRAVEL_CONF_BOOKS + PF_01_EXP_PRINT_PUBLICA_BOOKS + PF_01_EXP_OTH_BOOKS
pf_exp_operating_net: subtotal: PF_01_EXP_TOT_OPERATING_NET = PF_01_EXP_COMP_OFF_NET + PF_01_EXP_OTH_EMPL_SAL_NET + PF_01_EXP_PENSION_EMPL_NET + PF_01_EXP_LEGAL_BEN_NET + PF_01_EXP_ACC_FEE_NET + PF_01_EXP_OTH_PROF_FEE_NET + PF_01_EXP_INT_NET + PF_01_EXP_TAXES_NET + PF_01_EXP_DEPREC_NET + PF_01_EXP_OCCUPANCY_NET + PF_01_EXP_TRAVEL_CONF_NET + PF_01_EXP_PRINT_PUBLICA_NET + PF_01_EXP_OTH_NET
pf_exp_operating_adj_net: subtotal: PF_01_EXP_TOT_OPERATING_ADJ_NET = PF_01_EXP_COMP_OFF_ADJ_NET + PF_01_EXP_OTH_EMPL_SAL_ADJ_NET + PF_01_EXP_PENSION_EMPL_ADJ_NET + PF_01_EXP_LEGAL_BEN_ADJ_NET + PF_01_EXP_ACC_FEE_ADJ_NET + PF_01_EXP_OTH_PROF_FEE_ADJ_NET + PF_01_EXP_INT_ADJ_NET + PF_01_EXP_TAXES_ADJ_NET + PF_01_EXP_DEPREC_ADJ_NET + PF_01_EXP_OCCUPANCY_ADJ_NET + PF_01_EXP_TRAVEL_CONF_ADJ_NET + PF_01_EXP_PRINT_PUBLICA_ADJ_NET + PF_01_EXP_OTH_ADJ_NET
pf_exp_operating_disbmt: subtotal: PF_01_EXP_TOT_OPERATING_DISBMT = PF_01_EXP_COMP_OFF_DISBMT + PF_01_EXP_OTH_EMPL_SAL_DISBMT + PF_01_EXP_PENSION_EMPL_DISBMT + PF_01_EXP_LEGAL_BEN_DISBMT + PF_01_EXP_ACC_FEE_DISBMT + PF_01_EXP_OTH_PROF_FEE_DISBMT + PF_01_EXP_INT_DISBMT + PF_01_EXP_TAXES_DISBMT + PF_01_EXP_OCCUPANCY_DISBMT + PF_01_EXP_TRAVEL_CONF_DISBMT + PF_01_EXP_PRINT_PUBLICA_DISBMT + PF_01_EXP_OTH_DISBMT
pf_exp_total_books: grand_total: PF_01_EXP_TOT_EXP_DISBMT_BOOKS = PF_01_EXP_TOT_OPERATING_BOOKS + PF_01_EXP_CONTR_PAID_BOOKS
pf_exp_total_net: grand_total: PF_01_EXP_TOT_EXP_DISBMT_NET = PF_01_EXP_TOT_OPERATING_NET
pf_exp_total_adj_net: grand_total: PF_01_EXP_TOT_EXP_DISBMT_ADJ_NET = PF_01_EXP_TOT_OPERATING_ADJ_NET
pf_exp_total_disbmt: grand_total: PF_01_EXP_TOT_EXP_DISBMT_DISBMT = PF_01_EXP_TOT_OPERATING_DISBMT + PF_01_EXP_CONTR_PAID_DISBMT
"""
PF_BALANCE_SHEET = """
pf_bs_assets_eoy_fmv: subtotal: PF_02_ASSET_TOT_EOY_FMV = PF_02_ASSET_CASH_EOY_FMV + PF_02_ASSET_SAVING_EOY_FMV + PF_02_ASSET_ACC_EOY_FMV + PF_02_ASSET_PLEDGE_EOY_FMV + PF_02_ASSET_GRANT_EOY_FMV + PF_02_ASSET_RECVB_OFF_EOY_FMV + PF_02_ASSET_OTH_NOTE_EOY_FMV + PF_02_ASSET_INV_SALE_EOY_FMV + PF_02_ASSET_EXP_PREPAID_EOY_FMV + PF_02_ASSET_INVEST_GOV_EOY_FMV + PF_02_ASSET_INVEST_STCK_EOY_FMV + PF_02_ASSET_INVEST_BOND_EOY_FMV + PF_02_ASSET_INVEST_LAND_EOY_FMV + PF_02_ASSET_INVEST_MTG_EOY_FMV + PF_02_ASSET_INVEST_OTH_EOY_FMV + PF_02_ASSET_LAND_EOY_FMV + PF_02_ASSET_OTH_EOY_FMV
pf_bs_balance_boy: balance: PF_02_ASSET_TOT_BOY_BV = PF_02_NAFB_TOT_LIAB_NAFB_BOY_BV
pf_bs_assets_boy: subtotal: PF_02_ASSET_TOT_BOY_BV = PF_02_ASSET_CASH_BOY_BV + PF_02_ASSET_SAVING_BOY_BV + PF_02_ASSET_ACC_BOY_BV + PF_02_ASSET_PLEDGE_BOY_BV + PF_02_ASSET_GRANT_BOY_BV + PF_02_ASSET_RECVB_OFF_BOY_BV + PF_02_ASSET_OTH_NOTE_BOY_BV + PF_02_ASSET_INV_SALE_BOY_BV + PF_02_ASSET_EXP_PREPAID_BOY_BV + PF_02_ASSET_INVEST_GOV_BOY_BV + PF_02_ASSET_INVEST_STCK_BOY_BV + PF_02_ASSET_INVEST_BOND_BOY_BV + PF_02_ASSET_INVEST_LAND_BOY_BV + PF_02_ASSET_INVEST_MTG_BOY_BV + PF_02_ASSET_INVEST_OTH_BOY_BV + PF_02_ASSET_LAND_BOY_BV + PF_02_ASSET_OTH_BOY_BV
pf_bs_liabilities_boy: subtotal: PF_02_LIAB_TOT_BOY_BV = PF_02_LIAB_ACC_BOY_BV + PF_02_LIAB_GRANT_BOY_BV + PF_02_LIAB_REV_DEFERRED_BOY_BV + PF_02_LIAB_LOAN_OFF_BOY_BV + PF_02_LIAB_MTG_NOTE_BOY_BV + PF_02_LIAB_OTH_BOY_BV
pf_bs_net_assets_boy: subtotal: PF_02_NAFB_TOT_BOY_BV = PF_02_NAFB_UNRESTRICT_BOY_BV + PF_02_NAFB_RESTRICT_BOY_BV + PF_02_NAFB_CAP_STCK_BOY_BV + PF_02_NAFB_CAP_SURPLUS_BOY_BV + PF_02_NAFB_EARNING_RETAIN_BOY_BV
pf_bs_liab_net_assets_boy: subtotal: PF_02_NAFB_TOT_LIAB_NAFB_BOY_BV = PF_02_LIAB_TOT_BOY_BV + PF_02_NAFB_TOT_BOY_BV
pf_bs_balance_eoy: balance: PF_02_ASSET_TOT_EOY_BV = PF_02_NAFB_TOT_LIAB_NAFB_EOY_BV
pf_bs_assets_eoy: subtotal: PF_02_ASSET_TOT_EOY_BV = PF_02_ASSET_CASH_EOY_BV + PF_02_ASSET_SAVING_EOY_BV + PF_02_ASSET_ACC_EOY_BV + PF_02_ASSET_PLEDGE_EOY_BV + PF_02_ASSET_GRANT_EOY_BV + PF_02_ASSET_RECVB_OFF_EOY_BV + PF_02_ASSET_OTH_NOTE_EOY_BV + PF_02_ASSET_INV_SALE_EOY_BV + PF_02_ASSET_EXP_PREPAID_EOY_BV + PF_02_ASSET_INVEST_GOV_EOY_BV + PF_02_ASSET_INVEST_STCK_EOY_BV + PF_02_ASSET_INVEST_BOND_EOY_BV + PF_02_ASSET_INVEST_LAND_EOY_BV + PF_02_ASSET_INVEST_MTG_EOY_BV + PF_02_ASSET_INVEST_OTH_EOY_BV + PF_02_ASSET_LAND_EOY_BV + PF_02_ASSET_OTH_EOY_BV
pf_bs_liabilities_eoy: subtotal: PF_02_LIAB_TOT_EOY_BV = PF_02_LIAB_ACC_EOY_BV + PF_02_LIAB_GRANT_EOY_BV + PF_02_LIAB_REV_DEFERRED_EOY_BV + PF_02_LIAB_LOAN_OFF_EOY_BV + PF_02_LIAB_MTG_NOTE_EOY_BV + PF_02_LIAB_OTH_EOY_BV
pf_bs_net_assets_eoy: subtotal: PF_02_NAFB_TOT_EOY_BV = PF_02_NAFB_UNRESTRICT_EOY_BV + PF_02_NAFB_RESTRICT_EOY_BV + PF_02_NAFB_CAP_STCK_EOY_BV + PF_02_NAFB_CAP_SURPLUS_EOY_BV + PF_02_NAFB_EARNING_RETAIN_EOY_BV
pf_bs_liab_net_assets_eoy: subtotal: PF_02_NAFB_TOT_LIAB_NAFB_EOY_BV = PF_02_LIAB_TOT_EOY_BV + PF_02_NAFB_TOT_EOY_BV
"""
PF_NET_ASSETS = """
pf_na_subtotal: subtotal: PF_03_NAFB_CHANGE_SUBTOT = PF_03_NAFB_TOT_BOY_BV + PF_03_EXCESS_REV_OVER_EXP_BOOKS + PF_03_NAFB_OTH_INCREASE
pf_na_eoy: net: PF_03_NAFB_TOT_EOY = PF_03_NAFB_CHANGE_SUBTOT - PF_03_NAFB_OTH_DECREASE
pf_na_tie_excess: tie: PF_03_EXCESS_REV_OVER_EXP_BOOKS = PF_01_EXCESS_REV_OVER_EXP_BOOKS
pf_na_tie_boy: tie: PF_03_NAFB_TOT_BOY_BV = PF_02_NAFB_TOT_BOY_BV
pf_na_tie_eoy: tie: PF_03_NAFB_TOT_EOY = PF_02_NAFB_TOT_EOY_BV
"""
SECTIONS = (
    ("990", "revenue", F990_REVENUE),
    ("990", "expenses", F990_EXPENSES),
    ("990", "balance_sheet", F990_BALANCE_SHEET),
    ("990PF", "revenue", PF_REVENUE),
    ("990PF", "expenses", PF_EXPENSES),
    ("990PF", "balance_sheet", PF_BALANCE_SHEET),
    ("990PF", "net_assets", PF_NET_ASSETS),
)


def parse(text: str, section: str, form: str) -> list[Identity]:
    """Identities from lines of ``name: kind: left = right``: the left side counts 1, what the right side adds -1, what it takes away 1."""
    out = []
    for line in text.strip().splitlines():
        name, kind, equation = line.split(": ")
        left, right = equation.split(" = ")
        terms = [(left, 1.0)]
        for part in right.replace(" - ", " + -").split(" + "):
            terms.append((part[1:], 1.0) if part.startswith("-") else (part, -1.0))
        out.append(Identity(name, section, kind, tuple(terms), form))
    return out


IDENTITIES: tuple[Identity, ...] = tuple(i for form, section, text in SECTIONS for i in parse(text, section, form))


def registry(columns, section=None, identities=None) -> list[Identity]:
    """Identities of the sections asked for whose variables are all in ``columns``."""
    have = set(columns)
    wanted = None if section is None else {section} if isinstance(section, str) else set(section)
    known = {i.section for i in (identities or IDENTITIES)}
    if wanted is not None and (bad := wanted - known):
        raise ValueError(f"unknown section: {', '.join(sorted(bad))}")
    return [i for i in (identities or IDENTITIES) if (wanted is None or i.section in wanted) and have.issuperset(i.variables)]
