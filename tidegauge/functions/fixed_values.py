"""Word lists and tables that results depend on. All of them are fixed values."""

# Phrases of good financial news.
POSITIVE = (
    "lãi kỷ lục", "lợi nhuận kỷ lục", "doanh thu kỷ lục", "lãi đột biến", "lợi nhuận đột biến", "lợi nhuận tăng", "lợi nhuận tăng trưởng",
    "doanh thu tăng", "lãi ròng tăng", "lãi tăng mạnh", "tăng trưởng lợi nhuận", "biên lợi nhuận cải thiện", "có lãi trở lại", "thoát lỗ",
    "lãi sau thuế tăng", "vượt kế hoạch", "vượt chỉ tiêu", "vượt dự báo", "vượt kỳ vọng", "hoàn thành vượt mức", "hoàn thành kế hoạch", "chia cổ tức",
    "trả cổ tức", "cổ tức tiền mặt", "cổ tức cao", "thưởng cổ phiếu", "phát hành cổ phiếu thưởng", "trúng thầu", "trúng gói thầu", "ký hợp đồng",
    "ký kết hợp đồng", "nhận dự án", "khởi công dự án", "khối ngoại mua ròng", "được mua ròng", "khối ngoại gom", "tự doanh mua ròng", "tăng trần",
    "kịch trần", "tím trần", "dư mua trần", "bứt phá", "khởi sắc", "hồi phục", "phục hồi", "khả quan", "tích cực", "lạc quan", "sôi động",
    "đảo chiều tăng", "được nâng hạng", "nâng hạng", "nâng dự báo", "nâng khuyến nghị", "khuyến nghị mua", "tiềm năng tăng giá",
)

# Phrases of bad financial news.
NEGATIVE = (
    "thua lỗ", "lỗ ròng", "lỗ nặng", "lỗ lũy kế", "báo lỗ", "chuyển lỗ", "lỗ kỷ lục", "lợi nhuận giảm", "lợi nhuận sụt giảm", "doanh thu giảm",
    "lãi giảm", "lãi ròng giảm", "sụt giảm lợi nhuận", "lợi nhuận lao dốc", "vỡ nợ", "mất khả năng thanh toán", "chậm trả gốc", "chậm trả lãi",
    "chậm thanh toán", "khất nợ", "gia hạn nợ", "cơ cấu lại nợ", "nợ xấu", "trích lập dự phòng", "gánh nặng lãi vay", "áp lực đáo hạn", "giảm sàn",
    "nằm sàn", "dư bán sàn", "lao dốc", "rớt giá", "bốc hơi", "mất giá", "bán tháo", "đỏ lửa", "lao dốc mạnh", "giảm mạnh", "đảo chiều giảm",
    "khối ngoại bán ròng", "bị bán ròng", "khối ngoại xả", "tự doanh bán ròng", "hủy niêm yết", "hạn chế giao dịch", "đình chỉ giao dịch",
    "diện cảnh báo", "diện kiểm soát", "bị cảnh báo", "bị điều tra", "khởi tố", "bắt tạm giam", "thao túng", "làm giá", "vi phạm", "xử phạt", "bị phạt",
    "truy thu thuế", "bị hạ bậc", "hạ xếp hạng", "hạ dự báo", "hạ khuyến nghị", "khuyến nghị bán", "tiêu cực", "ảm đạm", "bi quan", "kém khả quan",
)

# Words that turn the phrase after them.
NEGATION = (
    "không", "chưa", "chẳng", "khó", "thiếu", "mất", "ngừng", "dừng", "hoãn",
)

# Tickers with their companies' names and sector.
COMPANIES = {
    "ACB": (("Ngân hàng Á Châu", "Á Châu Bank", "ACB Bank"), "Ngân hàng"),
    "BCM": (("Becamex", "Becamex IDC", "Đầu tư và Phát triển Công nghiệp"), "Bất động sản KCN"),
    "BID": (("BIDV", "Ngân hàng Đầu tư và Phát triển"), "Ngân hàng"),
    "BVH": (("Tập đoàn Bảo Việt", "Bảo Việt"), "Bảo hiểm"),
    "CTG": (("VietinBank", "Vietin Bank", "Ngân hàng Công Thương"), "Ngân hàng"),
    "FPT": (("Tập đoàn FPT", "FPT Corporation", "Công ty FPT"), "Công nghệ"),
    "GAS": (("PV GAS", "PV Gas", "Tổng công ty Khí Việt Nam", "Khí Việt Nam"), "Dầu khí"),
    "GVR": (("Công nghiệp Cao su Việt Nam", "Cao su Việt Nam", "Tập đoàn Cao su"), "Cao su"),
    "HDB": (("HDBank", "HD Bank", "Ngân hàng Phát triển TP"), "Ngân hàng"),
    "HPG": (("Tập đoàn Hòa Phát", "Hòa Phát", "Hoa Phat"), "Thép"),
    "LPB": (("LPBank", "LPBank", "Ngân hàng Lộc Phát", "Liên Việt Post Bank", "LienVietPostBank"), "Ngân hàng"),
    "MBB": (("Ngân hàng Quân đội", "MBBank", "MB Bank", "Ngân hàng MB"), "Ngân hàng"),
    "MSN": (("Tập đoàn Masan", "Masan Group", "Masan"), "Thực phẩm & Đồ uống"),
    "MWG": (("Thế Giới Di Động", "Đầu tư Thế Giới Di Động", "Mobile World", "Điện Máy Xanh", "Bách Hóa Xanh"), "Bán lẻ"),
    "PLX": (("Petrolimex", "Tập đoàn Xăng dầu Việt Nam", "Xăng dầu Việt Nam"), "Dầu khí"),
    "SAB": (("Sabeco", "Bia - Rượu - Nước giải khát Sài Gòn", "Bia Sài Gòn"), "Thực phẩm & Đồ uống"),
    "SHB": (("Ngân hàng Sài Gòn - Hà Nội", "Ngân hàng Sài Gòn Hà Nội", "SHBank"), "Ngân hàng"),
    "SSB": (("SeABank", "SeA Bank", "Ngân hàng Đông Nam Á"), "Ngân hàng"),
    "SSI": (("Chứng khoán SSI", "SSI Securities", "Công ty Chứng khoán SSI"), "Chứng khoán"),
    "STB": (("Sacombank", "Ngân hàng Sài Gòn Thương Tín"), "Ngân hàng"),
    "TCB": (("Techcombank", "Techombank", "Ngân hàng Kỹ Thương"), "Ngân hàng"),
    "TPB": (("TPBank", "TP Bank", "Ngân hàng Tiên Phong"), "Ngân hàng"),
    "VCB": (("Vietcombank", "Ngân hàng Ngoại thương"), "Ngân hàng"),
    "VHM": (("Vinhomes",), "Bất động sản"),
    "VIB": (("Ngân hàng Quốc tế Việt Nam", "Ngân hàng Quốc tế", "VIBank"), "Ngân hàng"),
    "VIC": (("Tập đoàn Vingroup", "Vingroup"), "Bất động sản"),
    "VJC": (("Vietjet Air", "Vietjet", "Hàng không Vietjet"), "Hàng không"),
    "VNM": (("Vinamilk", "Sữa Việt Nam", "Công ty Sữa Việt Nam"), "Thực phẩm & Đồ uống"),
    "VPB": (("VPBank", "VP Bank", "Ngân hàng Việt Nam Thịnh Vượng"), "Ngân hàng"),
    "VRE": (("Vincom Retail", "Vincom"), "Bất động sản"),
}

# Phrases in whose neighbourhood a ticker isn't one.
TICKER_TRAPS = {"GAS": ("NATURAL GAS",), "VIC": ("VICTORY", "VICTOR")}

# Index membership, from and (if it ended) to.
MEMBERSHIP = (
    ("ACB", "2012-02-06", None),
    ("BID", "2012-02-06", None),
    ("BVH", "2012-02-06", "2024-01-02"),
    ("CTG", "2012-02-06", None),
    ("DPM", "2012-02-06", "2020-07-01"),
    ("FPT", "2012-02-06", None),
    ("GAS", "2012-02-06", None),
    ("GMD", "2012-02-06", "2021-01-04"),
    ("HAG", "2012-02-06", "2020-07-01"),
    ("HDB", "2018-07-02", None),
    ("HPG", "2012-02-06", None),
    ("KDC", "2012-02-06", "2015-07-01"),
    ("MBB", "2012-02-06", None),
    ("MSN", "2012-02-06", None),
    ("MWG", "2016-07-01", None),
    ("NVL", "2020-01-02", "2023-01-03"),
    ("PDR", "2021-01-04", "2023-01-03"),
    ("PLX", "2017-07-03", None),
    ("POW", "2019-07-01", None),
    ("PNJ", "2018-01-02", "2022-07-01"),
    ("REE", "2012-02-06", "2018-07-02"),
    ("SAB", "2016-12-06", None),
    ("SBT", "2012-02-06", "2017-01-03"),
    ("SHB", "2022-01-03", None),
    ("SSB", "2021-07-01", None),
    ("SSI", "2012-02-06", None),
    ("STB", "2012-02-06", None),
    ("TCB", "2018-07-02", None),
    ("TPB", "2020-07-01", None),
    ("VCB", "2012-02-06", None),
    ("VHM", "2018-07-02", None),
    ("VIB", "2021-01-04", None),
    ("VIC", "2012-02-06", None),
    ("VJC", "2017-07-03", None),
    ("VNM", "2012-02-06", None),
    ("VPB", "2017-07-03", None),
    ("VRE", "2018-01-02", None),
    ("GVR", "2020-07-01", None),
    ("BCM", "2021-07-01", "2025-01-02"),
    ("LPB", "2024-01-02", "2025-01-02"),
    ("DGC", "2023-01-03", "2024-07-01"),
    ("HCM", "2017-01-03", "2019-01-02"),
    ("VND", "2022-07-01", "2024-01-02"),
    ("EIB", "2012-02-06", "2016-07-01"),
    ("CII", "2012-02-06", "2017-07-03"),
    ("PVD", "2012-02-06", "2016-01-04"),
    ("DHG", "2012-02-06", "2018-01-02"),
    ("IMP", "2012-02-06", "2013-07-01"),
    ("KBC", "2012-02-06", "2013-07-01"),
    ("PVI", "2012-02-06", "2015-01-05"),
)

# HTML elements, and class or id words, that hold no article text.
NOISE_TAGS = ("nav", "header", "footer", "aside", "script", "style", "noscript", "iframe", "form", "button", "select", "figure")
NOISE_WORDS = (
    "menu", "breadcrumb", "sidebar", "related", "suggest", "recommen", "comment", "discuss", "social", "share", "ads", "advert", "promo",
    "banner", "copyright", "paginat", "pager", "author-info", "writer-info",
)

# Words of footers.
FOOTER_WORDS = ("©", "bản quyền", "tòa soạn", "giấy phép", "tổng biên tập", "phó tổng biên tập", "điện thoại:", "email:", "fax:", "onecms", "mastercms", "issn")

# Parts of label names, by class, in the order they are looked for.
LABEL_PARTS = {"negative": ("neg", "tiêu", "tieu", "xấu", "xau"), "positive": ("pos", "tích", "tich", "tốt", "tot"), "neutral": ("neu", "trung")}

# Where pages state their date, in the order in which the places are tried.
DATE_METAS = ("article:published_time", "pubdate", "datePublished", "DC.date.issued")
DATE_CLASSES = ("story__time", "post-time", "format_date", "time", "post-date", "date", "tbts-date")
