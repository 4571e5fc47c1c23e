"""Rule-based routing of questions, follow-ups and refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.text import first_hit

#: Words of each route, in the order in which they are tried.
RULES = [
    ("out_of_scope", "조회로 답할 수 없는 주제: ", ["예매", "티켓", "상영관", "몇 시", "상영 시간표", "어디서 봐", "어디서 볼", "무료로 보", "다운로드", "토렌트", "자막 파일", "넷플릭스에 있", "왓챠에 있", "디즈니플러스에 있", "재밌을까", "재미있을까", "볼만할까", "평점 예측", "흥행할까"]),
    ("bridge", "다리를 건너야 함: ", ["와 함께", "과 함께", "함께 출연", "함께 주연", "같이 출연", "모두 출연", "자주 출연", "연기한 배우가", "맡은 배우가", "역의 배우가", "배우가 출연한", "배우가 주연", "같이 나온", "함께 나온", "나온 배우가", "나왔던 배우", "그 배우가", "같은 배우", "다른 영화", "또 나온", "에도 나온", "에도 출연", "감독이 만든", "같은 감독", "그 감독"]),
    ("award", "수상을 물음: ", ["황금종려", "칸 영화제", "베를린", "베니스", "아카데미", "오스카", "청룡", "대종상", "백상", "골든글로브", "수상", "상을 받", "상 받", "여우주연", "남우주연", "감독상", "작품상", "각본상", "황금곰", "은곰"]),
    ("filmography", "작품 목록을 물음: ", ["무슨 영화", "어떤 영화", "영화 뭐", "작품 뭐", "필모", "출연작", "연출작", "나온 영화", "만든 영화", "감독한", "출연한 영화"]),
    ("cast", "출연진을 물음: ", ["누가 나와", "누가 나오", "누가 출연", "나온 배우들", "나오는 배우들", "출연진", "출연자", "캐스팅", "배우들 알려", "배우들은", "배우 목록", "출연한 배우들", "누가 주연", "주연이 누구", "감독이 누구", "누가 만들"]),
    ("lookup", "배역으로 배우를 물음: ", ["역을 맡", "역을 연기", "역의 배우", "역할을 맡", "로 나온", "역 배우", "을 연기한", "를 연기한"]),
    ("similar", "유사 작품을 물음: ", ["비슷한", "같은 느낌", "추천", "볼 만한", "닮은"]),
]
FALLBACK = ("lookup", "특정 작품·인물의 정보로 본다")
#: Kinds that each route follows, and those without a quota.
PLANS = {
    "lookup": (["DIRECTED", "ACTED_IN"], ["DIRECTED"]),
    "filmography": ([], []),
    "bridge": (["ACTED_IN", "DIRECTED"], ["DIRECTED"]),
    "similar": (["ACTED_IN", "DIRECTED"], []),
    "award": (["ACTED_IN", "DIRECTED"], ["DIRECTED"]),
    "cast": ([], []),
    "out_of_scope": ([], []),
}
#: Words that point back at the last answer, and what to filter it by.
REFERS_BACK = ["그중", "그 중", "이중", "이 중", "거기서", "그것들", "그 영화들", "그 작품들", "방금", "위에서", "앞에서", "그 목록", "저 중", "그 가운데"]
NO_PREVIOUS = "앞선 질문이 없어 '그중에' 가 무엇을 가리키는지 알 수 없습니다"
NO_FILTER = "직전 결과에서 무엇을 걸러야 할지 알아내지 못해, 새 질문으로 찾았습니다"
FILTERS = [("수상작만", "상받|상을받|수상|상탄|상은", None), ("한국 작품만", "한국(영화)?(만|는|인)?", "외국|해외"), ("해외 작품만", "외국|해외", None), ("최근 순", "최근|최신|요즘|나중", None), ("오래된 순", "오래된|예전|옛날|처음", None), ("평점 높은 순", "평점|별점|높은|잘만든|좋은", None)]
GENRES = ["액션", "코미디", "드라마", "스릴러", "공포", "범죄", "로맨스", "SF", "애니메이션", "다큐멘터리", "판타지", "미스터리", "전쟁", "역사", "음악", "가족", "모험"]


def route(q: Column) -> tuple[Column, Column]:
    """(route, reason): the first rule with a word that the question holds."""
    hits = [first_hit(q, words) for _, _, words in RULES]
    name = F.coalesce(*(F.when(h.isNotNull(), F.lit(r)) for h, (r, _, _) in zip(hits, RULES)), F.lit(FALLBACK[0]))
    reason = F.coalesce(*(F.concat(F.lit(text), h) for h, (_, text, _) in zip(hits, RULES)), F.lit(FALLBACK[1]))
    return name, reason


def history_route(hits: Column, off_domain: Column) -> Column:
    """By the number of names a question holds."""
    return F.when(off_domain, "out_of_scope").when(hits == 0, "search").when(hits == 1, "lookup").otherwise("bridge")


def parse_filters(q: Column, genres: list[str] = GENRES) -> Column:
    """The labels of the filters in a question, in the order in which they apply."""
    bare = F.regexp_replace(q, r"\s+", "")
    found = [F.when(bare.rlike(yes) & (F.lit(True) if no is None else ~bare.rlike(no)), F.lit(label)) for label, yes, no in FILTERS]
    found += [F.when(bare.contains(g), F.lit(f"{g} 장르만")) for g in genres]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def follow_up(q: Column, has_previous: Column, genres: list[str] = GENRES) -> tuple[Column, Column, Column]:
    """(is_follow_up, filters, gave_up)."""
    refers, filters = first_hit(q, REFERS_BACK).isNotNull(), parse_filters(q, genres)
    ok = refers & has_previous & (F.size(filters) > 0)
    gave_up = F.when(refers & ~has_previous, F.lit(NO_PREVIOUS)).when(refers & (F.size(filters) == 0), F.lit(NO_FILTER))
    return ok, F.when(ok, filters).otherwise(F.array().cast("array<string>")), gave_up


def apply_filters(rows: DataFrame, genres: list[str]) -> DataFrame:
    """Rows of a previous answer (qid, pos, filters, awarded, ko, year, rating, genres, ...) that the filters keep, with new_pos.

    Filters keep what all of them keep; of several orders the last is the first to count.
    """
    has = lambda label: F.array_contains("filters", label)
    keep = (~has("수상작만") | F.col("awarded")) & (~has("한국 작품만") | F.col("ko")) & (~has("해외 작품만") | ~F.col("ko"))
    for g in genres:
        keep = keep & (~has(f"{g} 장르만") | F.array_contains("genres", g))
    zero = F.lit(0.0)
    order = [F.when(has("평점 높은 순"), -F.col("rating")).otherwise(zero), F.when(has("오래된 순"), F.coalesce("year", F.lit(9999)).cast("double")).otherwise(zero), F.when(has("최근 순"), -F.coalesce("year", F.lit(0)).cast("double")).otherwise(zero)]
    from pyspark.sql import Window

    return rows.where(keep).withColumn("new_pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order, "pos")))


def can_answer(route_name: Column, n_seeds: Column, n_evidence: Column) -> Column:
    """Why a question is refused; null if it isn't."""
    return F.when(route_name == "out_of_scope", "out_of_scope").when(n_seeds == 0, "no_seeds").when(n_evidence == 0, "no_evidence")


def premise(route_name: Column, n_people: Column, n_titles: Column, asks_actor: Column, common_actors: Column, together: Column, common_movies: Column, names_subject: Column) -> Column:
    """What a question wrongly takes for granted; null if nothing."""
    return (
        F.when(route_name.isin("filmography", "cast") & names_subject & (n_people == 0) & (n_titles == 0), "unknown_subject")
        .when(asks_actor & (n_titles >= 2) & (common_actors == 0), "no_common_actor")
        .when(together & (n_people >= 2) & (common_movies == 0), "no_common_movie")
    )
