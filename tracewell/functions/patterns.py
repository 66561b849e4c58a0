"""Character classes, word lists, units and patterns used across the engine.

``WS``, ``WORD`` and ``TERM`` are valid in both Java and RE2 syntax; patterns with
look-around are Java/Python only, ``JAVA_`` ones Java only.
"""

# Unicode white space, as str.split() sees it.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The same without the line feed.
WS_INLINE = r"[ \t\r\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The same two for Java alone, which looks single characters below 256 up in one table and asks for the others only
# where a character lies among them: ``WS`` asks one range after the other for every letter of a text.
_WIDE = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
JAVA_WS = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0" + _WIDE + "]"
JAVA_WS_INLINE = r"[ \t\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0" + _WIDE + "]"

WORD = r"[가-힣a-z]+|\p{Nd}+(?:[.,]\p{Nd}+)*"
LETTER_PAIR = r"(?=([가-힣a-z]{2}))"
TERM = r"[가-힣A-Za-z]{2,}"

CITATION = r"(?i)(?:CR|ATT)_[a-f0-9]{20}"
NUMBER = r"(?<![A-Za-z0-9_])[+-]?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?%?(?![A-Za-z0-9_])"
YEAR = r"(?<!\p{Nd})(?:19|20)\p{Nd}{2}(?!\p{Nd})"
CELL = r"(?<![\p{L}\p{N}_])[A-Z]{1,3}\p{Nd}{1,7}(?==)"
COMPANY = r"(?:(?:주식회사|㈜|\(주\))[\s\x{a0}\x{3000}]*)[가-힣A-Za-z0-9&.\-]{2,}"

STOP_TERMS = [
    "현재", "자료", "근거", "기준", "관련", "항목", "현황", "향후", "전망", "확인",
    "신용조사서", "첨부자료", "기타", "해당", "대한", "그리고", "또한", "으로", "에서",
]
ANCHOR_STOP = [
    "현재", "자료", "근거", "기준", "관련", "항목", "현황", "향후", "전망", "확인", "따르면",
    "신용조사서", "첨부자료", "기타", "해당", "대한", "그리고", "또한", "으로", "에서", "있으며",
]
PARTICLES = ["으로", "에서", "에게", "까지", "부터", "은", "는", "이", "가", "을", "를", "의", "에", "로"]

MONEY_FACTORS = {"원": "0.000001", "천원": "0.001", "만원": "0.01", "백만원": "1", "억원": "100"}
MILLION_UNIT = "백만원"
NUMBER_UNITS = ["억원", "백만원", "천만원", "만원", "천원", "원", "배", "개월", "년", "월", "일"]

COMPLETE_SUFFIXES = ["함", "임", "됨", "음", "필요함", "양호함", "판단됨", "예상됨", "전망됨", "확인됨"]
STYLE_PLACEHOLDER = r"(?i)\[(?:VALUE|PERIOD|COMPANY|DATE|ENTITY)\]"

EXPANSIONS = {
    "현금및현금성자산": ["현금성자산", "순부채", "자금조달비율"],
    "단기차입금": ["차입금", "유동부채", "금융부채"],
    "특수관계자": ["관계기업", "종속기업", "채권 채무", "주요 잔액"],
    "소송": ["법적소송우발부채", "계류법원", "소송 상대방", "소송 금액", "진행상황"],
    "공급자금융약정": ["매입채무", "단기차입금", "장부금액", "지급기일"],
    "영업활동현금흐름": ["현금흐름표", "당기순이익", "운전자본", "비현금", "조정"],
}
EXPANSION_LABEL = "\n검색개념: "
AMOUNT_MARKERS = ["금액", "잔액", "비교", "현금", "차입금"]
UNIT_MARKER = "단위"

OPINION_MARKERS = [
    "심사의견", "아까 의견", "방금 의견", "왜 그렇게", "근거가 뭐", "근거는 뭐",
    "a항목", "b항목", "c항목", "d항목", "e항목", "a 의견", "b 의견", "c 의견", "d 의견", "e 의견",
]
CASE_MARKERS = [
    "이 회사", "해당 회사", "해당 기업", "현재 기업", "본건", "이 심사건", "현재 심사건",
    "업로드", "첨부", "신용조사서", "사업보고서", "이 자료", "우리 자료", "이 기업",
]

REVIEW_ITEMS = ["A", "B", "C", "D", "E"]
ITEM_TITLES = {
    "A": "재무제표 주요계정(현황 및 향후전망)",
    "B": "수익성(현황 및 향후전망)",
    "C": "재무안정성 및 자산의 질(현황 및 향후전망)",
    "D": "현금흐름 및 채무상환능력(현황 및 향후전망)",
    "E": "주요 매출처 및 매출비중 변동 추이",
}
ITEM_PROFILE_TERMS = {
    "A": ["매출채권", "재고자산", "유형자산", "차입금", "운전자본", "계정 증감", "회수가능성", "평가손실", "향후 전망"],
    "B": ["매출액", "매출총이익", "영업이익", "당기순이익", "이익률", "원가율", "판관비", "일회성 손익", "수익성 전망"],
    "C": ["부채비율", "차입금의존도", "유동비율", "순차입금", "담보", "자산건전성", "매출채권 연령", "재고 노후화", "우발채무"],
    "D": ["영업활동현금흐름", "잉여현금흐름", "EBITDA", "원리금상환", "이자보상", "차입금 만기", "유동성", "상환재원", "현금흐름 전망"],
    "E": ["주요 매출처", "매출비중", "거래처 집중도", "상위 고객", "매출처 변동", "계약기간", "수주잔고", "산업 수요", "매출 전망"],
}
ITEM_WEIGHTS = {
    "A": {"매출채권": 1.5, "재고": 1.5, "차입금": 1.6, "운전자금": 1.4, "유형자산": 0.8, "자본": 1.0, "선수금": 0.9, "수주": 0.8},
    "B": {"매출": 1.2, "영업이익": 1.7, "당기순이익": 1.4, "원가": 1.2, "이익률": 1.4, "금융비용": 1.2, "손실": 1.5},
    "C": {"부채비율": 1.8, "차입금의존도": 1.8, "유동비율": 1.5, "차입금": 1.5, "자본": 1.3, "유동성": 1.4, "우발": 1.3, "담보": 1.0},
    "D": {"영업활동현금흐름": 2.0, "현금흐름": 1.5, "상환": 1.8, "이자": 1.3, "만기": 1.4, "차입금": 1.4, "현금": 1.2, "투자활동": 0.8},
    "E": {"매출처": 1.7, "매출비중": 1.7, "거래처": 1.5, "수주잔고": 1.3, "계약": 1.1, "집중": 1.4, "발주": 1.2},
}
CROSS_SIGNALS = {
    "PROFIT_CASHFLOW_ALIGNMENT": ({"B": ["영업이익", "당기순이익"]}, {"D": ["현금흐름"]}),
    "WORKING_CAPITAL_PRESSURE": ({"A": ["재고", "매출채권"]}, {"D": ["현금흐름"]}),
    "DEBT_CAPITAL_BALANCE": ({"A": ["차입금"], "C": ["차입금"]}, {"C": ["자본"]}),
}

# Document life cycle: status -> (allowed next statuses, default progress).
TRANSITIONS = {
    "UPLOADED": (["VALIDATING", "DELETING", "FAILED", "EXCLUDED"], 0),
    "VALIDATING": (["PARSING", "FAILED", "EXCLUDED", "DELETING"], 25),
    "PARSING": (["INDEXING", "READY", "FAILED", "EXCLUDED", "DELETING"], 45),
    "INDEXING": (["READY", "FAILED", "EXCLUDED", "DELETING"], 70),
    "READY": (["DELETING", "FAILED", "EXCLUDED"], 100),
    "FAILED": (["VALIDATING", "EXCLUDED", "DELETING"], 100),
    "EXCLUDED": (["VALIDATING", "DELETING"], 100),
    "DELETING": (["DELETED", "FAILED", "EXCLUDED"], 100),
    "DELETED": ([], 100),
}
PROGRESS_MAY_FALL = ["FAILED", "EXCLUDED", "DELETING", "DELETED"]

FAIL_REASONS = ["FACT_CONTRADICTION", "PERIOD_MISMATCH", "UNIT_MISMATCH", "SOURCE_CONFLICT"]
