"""The catalog of four product domains: bonds, domestic ETFs, overseas ETFs and funds."""

from __future__ import annotations

from lattica.plans.catalog import Attribute, Catalog, Domain, Enrichment, Guard, OutputView, SalePolicy, Subtype

# Scales, worst to best.
RATINGS = ("C", "C0", "CC0", "CCC", "B-", "B0", "B+", "BB-", "BB0", "BB+", "BBB-", "BBB0", "BBB+", "A-", "A0", "A+", "AA-", "AA0", "AA+", "AAA")
RISKS = ("매우높은위험(1등급)", "높은위험(2등급)", "다소높은위험(3등급)", "보통위험(4등급)", "낮은위험(5등급)", "매우낮은위험(6등급)")
FUND_RISKS = ("매우 높은 위험", "높은 위험", "다소 높은 위험", "보통 위험", "낮은 위험", "매우 낮은 위험")

# Concepts of each domain: name, column, kind of values, closed set or scale.
BONDS = (
    Attribute("신용등급", "crd_grd", "ordinal", RATINGS),
    Attribute("위험등급", "pd_risk_nm", "ordinal", RISKS),
    Attribute("잔존기간", "remaining_days", "numeric", unit="days"),
    Attribute("만기일", "mat_dt", "date"),
    Attribute("발행일", "isu_dt", "date"),
    Attribute("표면금리", "srfc_irt", "numeric"),
    Attribute("민평수익률", "applied_yield", "numeric", unit="percent"),
    Attribute("매수수익률", "buy_yield", "numeric", unit="percent"),
    Attribute("듀레이션", "dur", "numeric"),
    Attribute("컨벡시티", "cov", "numeric"),
    Attribute("평가가격", "eval_price", "numeric"),
    Attribute("발행잔액", "isu_bal_amt", "numeric"),
    Attribute("총발행금액", "bd_tisu_a", "numeric"),
    Attribute("통화", "curr_cd", "categorical", ("KRW",)),
    Attribute("상품유형", "std_pd_mcls_nm", "categorical", ("회사채", "특수채", "국공채")),
    Attribute("상품소분류", "std_pd_scls_nm", "categorical", ("일반사채", "공사채", "지역개발", "특수은행채", "은행채", "도시철도", "국고채", "국민주택", "공모지방채", "중앙은행채", "기타사채", "기타국채", "물가채")),
    Attribute("채권종류", "bd_knd", "categorical", ("Conduit회사채", "MBS", "국고채권", "국민주택1종", "국민주택2종", "금융지주회사채", "기업인수목적회사채", "기타금융투자전업회사채", "기타금융회사채", "도시철도공채", "모집지방채", "보험회사채", "부동산투자회사채", "시설대여채(리스)", "신용카드채", "외국환평형기금", "유동화수익증권", "유동화회사채", "일반은행채", "일반지방공사채", "일반특수법인채", "일반회사채", "재정증권", "증권금융채(특수금융)", "지방공사보상채권", "지역개발채", "집합투자회사채", "통화안정채권", "투자매매.중개채", "특수보상채권", "특수은행채", "할부금융채")),
    Attribute("모집구분", "bd_ofr_tcd", "categorical", ("공모", "사모")),
    Attribute("금리구분", "bd_inrt_tcd", "categorical", ("고정금리", "변동금리", "고정+변동금리")),
    Attribute("이자지급구분", "bd_intp_tcd", "categorical", ("이표채", "복리채", "할인채", "단리채")),
    Attribute("거래시장", "pd_exg_mkt", "categorical", ("장내", "장외")),
    Attribute("발행기관", "pd_pbcm", organisation=True),
    Attribute("발행사", "pd_pbcm", organisation=True),
    Attribute("퇴직연금편입가능여부", "pd_pen_tr_yn", "categorical", ("Y", "N")),
    Attribute("상품명", "pd_nm"),
    Attribute("상품코드", "pd_no"),
    Attribute("상품번호", "pd_no"),
    Attribute("ESG채권구분", "pd_nm", "categorical", ("녹색채권", "사회적채권", "지속가능채권")),
    Attribute("채권특수조건", "pd_nm", "categorical", ("강제상환채권", "중순위채권", "신권", "콜옵션부채권")),
    Attribute("세후수익률", "after_tax_yield", "numeric", unit="percent"),
)

DOMESTIC_ETFS = (
    Attribute("순자산", "pd_net_tamt", "numeric", unit="won"),
    Attribute("AUM", "du_last_aum", "numeric", unit="won"),
    Attribute("NAV", "du_last_nav", "numeric"),
    Attribute("위험등급", "pd_risk_nm", "ordinal", RISKS),
    Attribute("투자자산유형", "wu_inv_ast_type", "categorical", ("주식", "채권", "원자재", "대체투자", "혼합자산", "단기자금", "기타", "통화", "부동산")),
    Attribute("투자지역", "wu_inv_rgn", "categorical", ("국내", "미국", "글로벌", "중국", "아시아", "일본", "인도", "남미/북미", "유럽", "이머징/브릭스", "베트남")),
    Attribute("판매가능여부", "pd_sale_yn", "flag", true="1"),
    Attribute("거래종료일", "pd_lste_dt", "date"),
    Attribute("상장일", "pd_lstg_dt", "date"),
    Attribute("상품군", "pd_grp_no", "categorical", ("ETF", "ETN")),
    Attribute("운용사", "cu_fund_mgmt_co", "categorical", organisation=True),
    Attribute("운용전략", "cu_strtegy", "categorical", ("실물복제", "액티브", "합성복제")),
    Attribute("레버리지배수", "cu_lev_fector", "numeric"),
    Attribute("총보수율", "expense_ratio", "numeric", join="pm"),
    Attribute("보수", "expense_ratio", "numeric", join="pm"),
    Attribute("기초지수", "ref_base_index"),
    Attribute("1개월수익률", "du_er_1m", "numeric", unit="percent"),
    Attribute("3개월수익률", "du_er_3m", "numeric", unit="percent"),
    Attribute("6개월수익률", "du_er_6m", "numeric", unit="percent"),
    Attribute("1년수익률", "du_er_1y", "numeric", unit="percent"),
    Attribute("연초대비수익률", "du_er_ytd", "numeric", unit="percent"),
    Attribute("변동성", "du_vlty_1y", "numeric"),
    Attribute("추적오차율", "du_chas_errt", "numeric"),
    Attribute("괴리율", "du_diff_rt", "numeric", unit="percent"),
    Attribute("분배수익률", "pd_dvid_yield", "numeric", unit="percent"),
    Attribute("분배주기", "pd_dvid_cycl", "categorical", ("M", "Q", "S", "A")),
    Attribute("거래대금", "du_val_1d", "numeric"),
    Attribute("거래량", "du_vol_1d", "numeric"),
    Attribute("종가", "du_clpr", "numeric"),
    Attribute("현재가", "ru_mkt_price", "numeric"),
    Attribute("연금거래가능여부", "pd_pen_tr_yn", "categorical", ("Y", "N")),
    Attribute("상품명", "pd_nm"),
    Attribute("티커", "ticker", join="etf_ref"),
    Attribute("상품코드", "pd_itm_no"),
    Attribute("상품번호", "pd_itm_no"),
    Attribute("거래정지여부", "pd_tr_yn", "boolean", true="1", false="0", true_words=("거래정지", "정지"), false_words=("거래정지아님", "정지아님", "정상", "거래가능")),
)

OVERSEAS_ETFS = (
    Attribute("순자산", "du_last_aum", "numeric", unit="dollar", currency=("pd_trd_ccy", "USD")),
    Attribute("투자자산유형", "wu_inv_ast_type", "categorical", ("Equity", "Alternatives", "Bond", "Mixed Assets", "Commodity", "Money Market")),
    Attribute("투자지역", "wu_inv_rgn", "categorical"),
    Attribute("상장거래소", "pd_exg_mkt_cd", "categorical", ("AMX", "NAS", "NYS")),
    Attribute("총보수율", "cu_charge_rt", "numeric", unit="percent"),
    Attribute("보수", "cu_charge_rt", "numeric", unit="percent"),
    Attribute("상품군", "pd_grp_no", "categorical", ("ETF", "ETN")),
    Attribute("운용사", "cu_fund_mgmt_co", organisation=True),
    Attribute("기초지수", "cu_base_index"),
    Attribute("운용전략", "cu_strtegy"),
    Attribute("복제방법", "cu_index_repl_mthd", "categorical", ("Full", "Optimized", "Swap")),
    Attribute("복제방식", "cu_index_repl_mthd", "categorical", ("Full", "Optimized", "Swap")),
    Attribute("지수복제방식", "cu_index_repl_mthd", "categorical", ("Full", "Optimized", "Swap")),
    Attribute("레버리지배수", "cu_lev_fector", "numeric"),
    Attribute("설정일", "pd_lstg_dt", "date"),
    Attribute("1일수익률", "du_er_1d", "numeric", unit="percent"),
    Attribute("종가", "du_clpr", "numeric"),
    Attribute("현재가", "ru_mkt_price", "numeric"),
    Attribute("거래량", "du_vol_1d", "numeric"),
    Attribute("거래대금", "du_val_1d", "numeric"),
    Attribute("상장주식수", "pd_lst_stk_cnt", "numeric"),
    Attribute("티커", "pd_abrv_nm"),
    Attribute("상품명", "pd_nm"),
    Attribute("상품코드", "pd_itm_no"),
    Attribute("상품번호", "pd_itm_no"),
)

FUNDS = (
    Attribute("순자산", "fd_nast_suma", "numeric", unit="won"),
    Attribute("위험등급", "zrin_fd_ivst_risk_grd_nm", "ordinal", FUND_RISKS),
    Attribute("펀드유형", "or_attr_desc", "categorical", ("주식형", "채권형", "재간접", "채권혼합", "파생상품", "혼합자산", "주식혼합", "특별자산", "MMF", "임대형", "기타", "대출형", "개발형", "해당없음")),
    Attribute("판매가능여부", "sale_yn", "flag", true="판매중"),
    Attribute("공모사모구분", "prvo_pbff_desc", "categorical", ("공모", "사모")),
    Attribute("투자지역", "fd_ivst_rgn_desc", "categorical", ("국내", "글로벌", "해당없음", "아시아", "남미/북미", "유럽", "이머징/브릭스", "기타", "중동/아프리카")),
    Attribute("해외국내구분", "ovrs_fd_desc", "categorical", ("국내", "해외", "국내외혼합", "해당없음")),
    Attribute("통화", "curr_cd", "categorical", ("KRW", "USD", "EUR", "JPY", "AUD", "GBP", "SEK")),
    Attribute("환헤지여부", "exchdg_yn", "categorical", ("Y", "N")),
    Attribute("이자배당구분", "int_dvd_desc", "categorical", ("배당", "이자", "해당없음")),
    Attribute("판매채널", "han_clas_sales_channel", "categorical", ("온라인", "오프라인", "직판")),
    Attribute("수수료유형", "han_clas_fee_type", "categorical", ("수수료미징구", "수수료선취", "수수료후취")),
    Attribute("클래스명", "han_clas_nm"),
    Attribute("판매회사보수", "sale_co_rwrd_r", "numeric"),
    Attribute("운용보수", "or_co_rwrd_r", "numeric"),
    Attribute("신탁보수", "trusc_rwrd_r", "numeric"),
    Attribute("사무관리보수", "ofwk_trus_rwrd_r", "numeric"),
    Attribute("1개월수익률", "fd_mm1_ern_r", "numeric"),
    Attribute("3개월수익률", "fd_mm3_ern_r", "numeric"),
    Attribute("6개월수익률", "fd_mm6_ern_r", "numeric"),
    Attribute("1년수익률", "fd_yr1_ern_r", "numeric"),
    Attribute("2년수익률", "fd_yr2_ern_r", "numeric"),
    Attribute("3년수익률", "fd_yr3_ern_r", "numeric"),
    Attribute("5년수익률", "fd_yr5_ern_r", "numeric"),
    Attribute("국내주식구성비율", "zrin_dmst_stk_cmst_rt", "numeric", unit="percent"),
    Attribute("해외주식구성비율", "zrin_ovrs_stk_cmst_rt", "numeric", unit="percent"),
    Attribute("국내채권구성비율", "zrin_dmst_bd_cmst_rt", "numeric", unit="percent"),
    Attribute("해외채권구성비율", "zrin_ovrs_bd_cmst_rt", "numeric", unit="percent"),
    Attribute("벤치마크", "bmrk_nm"),
    Attribute("상품명", "itm_nm"),
    Attribute("상품코드", "itm_no"),
    Attribute("상품번호", "itm_no"),
    Attribute("대표종목번호", "rptt_ksd_itm_no"),
)

# Other names of concepts.
ALIASES = {
    "채권": {"잔존일수": "잔존기간", "쿠폰금리": "표면금리", "원신용등급": "신용등급", "만기": "만기일"},
    "국내ETF": {"총보수": "총보수율", "총보수요율": "총보수율", "판매상태": "판매가능여부", "판매여부": "판매가능여부", "현재AUM": "AUM", "최종AUM": "AUM"},
    "해외ETF": {"AUM": "순자산", "현재AUM": "순자산", "순자산(AUM)": "순자산", "총보수": "총보수율", "총보수요율": "총보수율"},
    "펀드": {"판매상태": "판매가능여부", "판매여부": "판매가능여부", "AUM": "순자산"},
}

# Kinds of product that a request may name, and what tells them: column, comparison, stored value.
KINDS = {
    "채권": {
        "국공채": Subtype("std_pd_mcls_nm", "eq", "국공채"),
        "특수채": Subtype("std_pd_mcls_nm", "eq", "특수채"),
        "회사채": Subtype("std_pd_mcls_nm", "eq", "회사채"),
        "공모지방채": Subtype("std_pd_scls_nm", "eq", "공모지방채"),
        "공사채": Subtype("std_pd_scls_nm", "eq", "공사채"),
        "국고채": Subtype("std_pd_scls_nm", "eq", "국고채"),
        "국민주택": Subtype("std_pd_scls_nm", "eq", "국민주택"),
        "기타국채": Subtype("std_pd_scls_nm", "eq", "기타국채"),
        "기타사채": Subtype("std_pd_scls_nm", "eq", "기타사채"),
        "도시철도": Subtype("std_pd_scls_nm", "eq", "도시철도"),
        "물가채": Subtype("std_pd_scls_nm", "eq", "물가채"),
        "은행채": Subtype("std_pd_scls_nm", "eq", "은행채"),
        "일반사채": Subtype("std_pd_scls_nm", "eq", "일반사채"),
        "중앙은행채": Subtype("std_pd_scls_nm", "eq", "중앙은행채"),
        "지역개발": Subtype("std_pd_scls_nm", "eq", "지역개발"),
        "Conduit회사채": Subtype("bd_knd", "eq", "Conduit회사채"),
        "MBS": Subtype("bd_knd", "eq", "MBS"),
        "국고채권": Subtype("bd_knd", "eq", "국고채권"),
        "국민주택1종": Subtype("bd_knd", "eq", "국민주택1종"),
        "국민주택2종": Subtype("bd_knd", "eq", "국민주택2종"),
        "금융지주회사채": Subtype("bd_knd", "eq", "금융지주회사채"),
        "기업인수목적회사채": Subtype("bd_knd", "eq", "기업인수목적회사채"),
        "기타금융투자전업회사채": Subtype("bd_knd", "eq", "기타금융투자전업회사채"),
        "기타금융회사채": Subtype("bd_knd", "eq", "기타금융회사채"),
        "도시철도공채": Subtype("bd_knd", "eq", "도시철도공채"),
        "모집지방채": Subtype("bd_knd", "eq", "모집지방채"),
        "보험회사채": Subtype("bd_knd", "eq", "보험회사채"),
        "부동산투자회사채": Subtype("bd_knd", "eq", "부동산투자회사채"),
        "시설대여채": Subtype("bd_knd", "eq", "시설대여채(리스)"),
        "리스채": Subtype("bd_knd", "eq", "시설대여채(리스)"),
        "신용카드채": Subtype("bd_knd", "eq", "신용카드채"),
        "외국환평형기금": Subtype("bd_knd", "eq", "외국환평형기금"),
        "유동화수익증권": Subtype("bd_knd", "eq", "유동화수익증권"),
        "유동화회사채": Subtype("bd_knd", "eq", "유동화회사채"),
        "일반은행채": Subtype("bd_knd", "eq", "일반은행채"),
        "일반지방공사채": Subtype("bd_knd", "eq", "일반지방공사채"),
        "일반특수법인채": Subtype("bd_knd", "eq", "일반특수법인채"),
        "일반회사채": Subtype("bd_knd", "eq", "일반회사채"),
        "재정증권": Subtype("bd_knd", "eq", "재정증권"),
        "증권금융채": Subtype("bd_knd", "eq", "증권금융채(특수금융)"),
        "지방공사보상채권": Subtype("bd_knd", "eq", "지방공사보상채권"),
        "지역개발채": Subtype("bd_knd", "eq", "지역개발채"),
        "집합투자회사채": Subtype("bd_knd", "eq", "집합투자회사채"),
        "통화안정채권": Subtype("bd_knd", "eq", "통화안정채권"),
        "투자매매중개채": Subtype("bd_knd", "eq", "투자매매.중개채"),
        "특수보상채권": Subtype("bd_knd", "eq", "특수보상채권"),
        "특수은행채": Subtype("bd_knd", "eq", "특수은행채"),
        "할부금융채": Subtype("bd_knd", "eq", "할부금융채"),
        "고정금리": Subtype("bd_inrt_tcd", "eq", "고정금리"),
        "변동금리": Subtype("bd_inrt_tcd", "eq", "변동금리"),
        "고정변동금리": Subtype("bd_inrt_tcd", "eq", "고정+변동금리"),
        "혼합형금리": Subtype("bd_inrt_tcd", "eq", "고정+변동금리"),
        "단리채": Subtype("bd_intp_tcd", "eq", "단리채"),
        "복리채": Subtype("bd_intp_tcd", "eq", "복리채"),
        "이표채": Subtype("bd_intp_tcd", "eq", "이표채"),
        "할인채": Subtype("bd_intp_tcd", "eq", "할인채"),
        "장내": Subtype("pd_exg_mkt", "eq", "장내"),
        "장내거래": Subtype("pd_exg_mkt", "eq", "장내"),
        "장내채권": Subtype("pd_exg_mkt", "eq", "장내"),
        "장외": Subtype("pd_exg_mkt", "eq", "장외"),
        "장외거래": Subtype("pd_exg_mkt", "eq", "장외"),
        "장외채권": Subtype("pd_exg_mkt", "eq", "장외"),
        "공모": Subtype("bd_ofr_tcd", "eq", "공모"),
        "공모발행": Subtype("bd_ofr_tcd", "eq", "공모"),
        "공모채권": Subtype("bd_ofr_tcd", "eq", "공모"),
        "사모": Subtype("bd_ofr_tcd", "eq", "사모"),
        "사모발행": Subtype("bd_ofr_tcd", "eq", "사모"),
        "사모채권": Subtype("bd_ofr_tcd", "eq", "사모"),
        "녹색채권": Subtype("pd_nm", "contains", "(녹)"),
        "사회적채권": Subtype("pd_nm", "contains", "(사)"),
        "지속가능채권": Subtype("pd_nm", "contains", "(지)"),
        "ESG채권": Subtype("pd_nm", "contains", "(녹)"),
        "강제상환채권": Subtype("pd_nm", "contains", "(강제)"),
        "강제상환": Subtype("pd_nm", "contains", "(강제)"),
        "중순위채권": Subtype("pd_nm", "contains", "(중)"),
        "중순위": Subtype("pd_nm", "contains", "(중)"),
        "신권": Subtype("pd_nm", "contains", "(신)"),
        "콜옵션부채권": Subtype("pd_nm", "contains", "(콜)"),
        "콜옵션": Subtype("pd_nm", "contains", "(콜)"),
        "후순위채권": Subtype("pd_nm", "contains", "(후)"),
        "후순위": Subtype("pd_nm", "contains", "(후)"),
        "풋옵션부채권": Subtype("pd_nm", "contains", "(풋)"),
        "풋옵션": Subtype("pd_nm", "contains", "(풋)"),
        "전환사채": Subtype("pd_nm", "contains", "(전환)"),
        "교환사채": Subtype("pd_nm", "contains", "(교환)"),
        "조건부자본증권": Subtype("pd_nm", "contains", "(조건상각)"),
        "상각형조건부자본증권": Subtype("pd_nm", "contains", "(조건상각)"),
    },
    "국내ETF": {
        "일반": Subtype("cu_lev_fector", "eq", "1"),
        "일반(정방향)": Subtype("cu_lev_fector", "eq", "1"),
        "일반(1배)": Subtype("cu_lev_fector", "eq", "1"),
        "1배": Subtype("cu_lev_fector", "eq", "1"),
        "정방향": Subtype("cu_lev_fector", ">", "0"),
        "레버리지": Subtype("cu_lev_fector", ">", "1"),
        "인버스": Subtype("cu_lev_fector", "<", "0"),
        "실물복제": Subtype("cu_strtegy", "eq", "실물복제"),
        "합성복제": Subtype("cu_strtegy", "eq", "합성복제"),
        "액티브": Subtype("cu_strtegy", "eq", "액티브"),
    },
    "해외ETF": {
        "레버리지": Subtype("cu_lev_fector", ">", "1"),
        "인버스": Subtype("cu_lev_fector", "<", "0"),
    },
    "펀드": {
        "주식형": Subtype("or_attr_desc", "eq", "주식형"),
        "채권형": Subtype("or_attr_desc", "eq", "채권형"),
        "채권혼합": Subtype("or_attr_desc", "eq", "채권혼합"),
        "주식혼합": Subtype("or_attr_desc", "eq", "주식혼합"),
        "혼합자산": Subtype("or_attr_desc", "eq", "혼합자산"),
        "혼합형": Subtype("or_attr_desc", "eq", "혼합자산"),
        "재간접": Subtype("or_attr_desc", "eq", "재간접"),
        "특별자산": Subtype("or_attr_desc", "eq", "특별자산"),
        "MMF": Subtype("or_attr_desc", "eq", "MMF"),
        "파생상품": Subtype("or_attr_desc", "eq", "파생상품"),
        "공모": Subtype("prvo_pbff_desc", "eq", "공모"),
        "공모펀드": Subtype("prvo_pbff_desc", "eq", "공모"),
        "사모": Subtype("prvo_pbff_desc", "eq", "사모"),
        "사모펀드": Subtype("prvo_pbff_desc", "eq", "사모"),
    },
}

# Output views: kind, input columns, other names, periods or axes.
VIEWS = {
    "채권": {
        "등급서열규칙": OutputView("rating_order", aliases=("등급 서열 규칙", "신용등급 서열", "등급 순서")),
        "원본등급값": OutputView("raw_rating", ("crd_grd",), aliases=("원본 등급값", "원본 신용등급", "원등급", "원시 등급값")),
        "온톨로지분류값": OutputView("rating", ("crd_grd",), aliases=("온톨로지 분류값", "신용등급 온톨로지 분류값", "정규화 신용등급", "정규화 등급값")),
        "만기구분": OutputView("maturity", ("mat_dt", "info_base_dt"), aliases=("만기 구분", "잔존만기 구분", "만기 분류")),
    },
    "국내ETF": {
        "분류근거": OutputView("classification", ("wu_inv_ast_type", "wu_inv_rgn", "cu_strtegy"), aliases=("분류 근거", "분류 경로", "온톨로지 분류 근거"), axes=(("wu_inv_ast_type", "AssetType"), ("wu_inv_rgn", "InvestmentRegion"), ("cu_strtegy", "ManagementStrategy"),)),
        "복제방식": OutputView("classification", ("cu_strtegy",), aliases=("복제 방식", "지수 복제 방식"), axes=(("cu_strtegy", "ReplicationMethod"),)),
        "상품동일성키": OutputView("identity_keys", ("pd_itm_no", "pd_lstg_dt", "pd_lste_dt")),
        "상장여부": OutputView("listing", ("pd_lstg_dt", "pd_lste_dt", "cu_upt_dt"), aliases=("상장 상태",)),
        "수익률": OutputView("return_series", ("du_er_1d", "du_er_1m", "du_er_3m", "du_er_6m", "du_er_1y", "du_er_ytd"), periods=("1일", "1개월", "3개월", "6개월", "1년", "연초 대비")),
    },
    "해외ETF": {
        "분류근거": OutputView("classification", ("wu_inv_ast_type", "wu_inv_rgn", "cu_index_repl_mthd"), aliases=("분류 근거", "분류 경로", "온톨로지 분류 근거"), axes=(("wu_inv_ast_type", "AssetType"), ("wu_inv_rgn", "InvestmentRegion"), ("cu_index_repl_mthd", "ReplicationMethod"),)),
        "수익률": OutputView("return_series", ("du_er_1d",), periods=("1일",)),
    },
    "펀드": {
        "상품동일성키": OutputView("identity_keys", ("itm_no", "ksd_itm_no", "mtco_itm_no", "rptt_ksd_itm_no", "or_co_xtn_itt_cd")),
        "상장여부": OutputView("unsupported", aliases=("상장 상태",), reason="the fund table has no column for listing"),
        "수익률": OutputView("return_series", ("fd_mm1_ern_r", "fd_mm3_ern_r", "fd_mm6_ern_r", "fd_yr1_ern_r", "fd_yr2_ern_r", "fd_yr3_ern_r", "fd_yr5_ern_r"), periods=("1개월", "3개월", "6개월", "1년", "2년", "3년", "5년")),
        "클래스": OutputView("share_class", ("itm_nm",), aliases=("클래스 코드", "클래스 구분")),
    },
}

GROUP = Guard("pd_grp_no", "ETF", "ETN")

PRODUCTS = Catalog(
    [
        Domain("채권", "raw.prbd01n001", "pd_no", "pd_nm", ("pd_nm", "pd_abrv_nm", "pd_no"), {a.name: a for a in BONDS}, ALIASES["채권"], subtypes=KINDS["채권"], views=VIEWS["채권"], sale=SalePolicy("no column says what is on sale")),
        Domain(
            "국내ETF", "raw.pref01n001", "pd_itm_no", "pd_nm", ("pd_nm", "pd_abrv_nm", "pd_itm_no", "pd_ticker"), {a.name: a for a in DOMESTIC_ETFS}, ALIASES["국내ETF"],
            {"pm": Enrichment("enriched.expense_ratio", "pd_itm_no", "pd_itm_no"), "etf_ref": Enrichment("enriched.etf_kr", "pd_itm_no", "pd_itm_no")},
            KINDS["국내ETF"], SalePolicy("pd_sale_yn tells products that are no longer listed", "pd_sale_yn", "1"), VIEWS["국내ETF"], GROUP,
        ),
        Domain("해외ETF", "raw.pref02n001", "pd_itm_no", "pd_nm", ("pd_nm", "pd_abrv_nm", "pd_itm_no", "pd_isin_cd"), {a.name: a for a in OVERSEAS_ETFS}, ALIASES["해외ETF"], subtypes=KINDS["해외ETF"], views=VIEWS["해외ETF"], sale=SalePolicy("the column is the same in every row"), guard=GROUP),
        Domain("펀드", "raw.prfd01n001", "itm_no", "itm_nm", ("itm_nm", "itm_abrv_nm", "itm_no"), {a.name: a for a in FUNDS}, ALIASES["펀드"], subtypes=KINDS["펀드"], views=VIEWS["펀드"], sale=SalePolicy("sale_yn says it", "sale_yn", "판매중"), class_column="itm_nm"),
    ]
)
