"""Phrases of chat messages in Vietnamese and English, as tables for `slatewise.operators.conversation`."""

from __future__ import annotations

from slatewise.operators.conversation import Critiques, Grammar, Intent, Language, Number, Span

#: Hints of a genre in a critique, in the order they are looked for.
CRITIQUE_HINTS = {"funny": "Comedy", "funnier": "Comedy", "hài": "Comedy", "hài hước": "Comedy", "scary": "Horror", "scarier": "Horror", "kinh dị": "Horror", "ma": "Horror", "romantic": "Romance", "tình cảm": "Romance", "lãng mạn": "Romance", "action-packed": "Action", "hành động": "Action", "animation": "Animation", "hoạt hình": "Animation", "sci-fi": "Sci-Fi", "khoa học viễn tưởng": "Sci-Fi", "drama": "Drama", "tâm lý": "Drama", "thriller": "Thriller", "giật gân": "Thriller"}
#: Words that name a genre in a wish.
GENRE_WORDS = {"action": "Action", "hành động": "Action", "adventure": "Adventure", "phiêu lưu": "Adventure", "animation": "Animation", "hoạt hình": "Animation", "anime": "Animation", "comedy": "Comedy", "hài": "Comedy", "hài hước": "Comedy", "crime": "Crime", "tội phạm": "Crime", "hình sự": "Crime", "documentary": "Documentary", "tài liệu": "Documentary", "drama": "Drama", "tâm lý": "Drama", "chính kịch": "Drama", "fantasy": "Fantasy", "giả tưởng": "Fantasy", "horror": "Horror", "kinh dị": "Horror", "phim ma": "Horror", "mystery": "Mystery", "bí ẩn": "Mystery", "trinh thám": "Mystery", "romance": "Romance", "lãng mạn": "Romance", "tình cảm": "Romance", "sci-fi": "Sci-Fi", "scifi": "Sci-Fi", "khoa học viễn tưởng": "Sci-Fi", "viễn tưởng": "Sci-Fi", "thriller": "Thriller", "giật gân": "Thriller", "hồi hộp": "Thriller", "war": "War", "chiến tranh": "War", "western": "Western", "cao bồi": "Western"}
#: Letters and words of Vietnamese.
VIETNAMESE = Language("vi", letters="ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ", words=["phim", "tìm", "gợi", "cho", "tôi", "muốn", "xem", "nào", "hay", "không", "hài", "kinh", "dị", "chiến", "tranh", "tình", "cảm", "hành", "động", "hoạt", "hình", "chào", "bạn", "giúp", "nhé", "ạ", "ơn", "mà", "đạo", "diễn", "viên", "bao", "nhiêu", "giải", "thích", "kết", "thúc", "thêm", "nữa", "tiếp", "khác"])

CRITIQUES = Critiques(
    triggers=["more", "funnier", "scarier", "newer", "older", "higher", "better rated", "hài hơn", "mới hơn", "cũ hơn", "hay hơn", "another", "khác", "tiếp", "đừng", "không thích", "không muốn", "bỏ qua", "without", "no"],
    exclusions=["không thích", "đừng", "bỏ qua", "không muốn", "ko thích", "đừng gợi ý", "without", "no", "don't like", "hate", "exclude", "not"],
    hints=CRITIQUE_HINTS,
    rating=Number(leads=["above", "over", ">", ">="], marks=["+"]),
    newer=["newer", "mới hơn"],
    older=["older", "cũ hơn", "classic"],
    newer_year=2015,
    older_year=2005,
)

_ENDS = ["năm", "điểm", "diễn", "hay", "và"]
GRAMMAR = Grammar(
    languages=[VIETNAMESE],
    genres=GENRE_WORDS,
    spans={
        "detail": Span(leads=["chi tiết", "thông tin", "nội dung", "cốt truyện", "giới thiệu", "review", "tìm hiểu", "về bộ phim", "về phim", "details of", "about movie", "tell me about", "info on", "synopsis of"], fillers=["về"], tails=["đi", "nhé", "ạ", "cho tôi", "nào"], never=["gì", "nào"]),
        "similar": Span(leads=["similar to", "movies like", "films like", "resemble", "tương tự", "giống phim", "giống như", "phim nào giống", "phim tương tự"]),
        "director": Span(leads=["đạo diễn", "directed by", "director"], fillers=["là"], stops=_ENDS),
        "actor": Span(leads=["diễn viên", "starring", "đóng bởi", "diễn xuất bởi", "có sự tham gia của", "có"], fillers=["là"], stops=["đóng", "đạo diễn", *_ENDS], never=["gì", "thể", "nào", "gì không"], unless=["có thể"]),
    },
    rating=Number(leads=["điểm", "rating", "imdb"], fillers=["trên", ">=", ">"]),
    intents=[
        Intent("general_qa", says=["chào", "hello", "hi", "hey", "alo", "bạn là ai", "bạn có thể", "who are you", "what can you do", "giải thích", "cốt truyện", "kết thúc", "ý nghĩa", "plot of", "ending of"]),
        Intent("more_recommendations", says=["cho thêm", "gợi ý thêm", "còn phim nào", "còn bộ nào", "xem thêm", "tiếp theo", "nữa không", "thêm phim", "phim khác", "more movies", "show me more", "give me more", "what else", "other movies", "next recommendations"]),
        Intent("movie_detail", holds="detail"),
        Intent("similar", holds="similar"),
        Intent("sql_query", says=["bao nhiêu phim", "tổng số phim", "how many movies", "total movies", "danh sách theo dõi", "watchlist", "phim tôi đã lưu"], keeps=True),
        Intent("search_filter", searches=True, keeps=True),
        Intent("personalized", says=["recommend", "suggest", "for me", "what to watch", "gợi ý", "cho tôi", "phim hay", "nên xem", "top movie", "best movie", "bộ phim nào"]),
        Intent("followup", says=["first", "second", "third", "thứ nhất", "thứ hai", "bộ đó", "phim đó"]),
    ],
)
