"""Each site's notices from small pages written for these tests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

BASE = "https://site.example/top/index.html"

PAGES = {
    "bills": """<table><caption>閣法の一覧</caption><tr><th>回次</th></tr>
<tr><td>213</td><td>5</td><td>甲法案</td><td>成立</td><td><a href="text.html">本文</a></td><td><a href="../p/5.html">経過</a></td></tr>
<tr><td>213</td><td></td><td>乙法案</td><td></td></tr><tr><td>回</td><td>1</td><td>丙</td><td>x</td></tr></table>
<table><caption>その他</caption><tr><td>1</td><td>2</td><td>丁</td><td>未了</td></tr></table>""",
    "exchange_comments": """<table><tr><th>募集開始日</th><th>募集終了日</th><th>法人</th><th>案件名</th></tr>
<tr><td>2024/01/05</td><td>2024/02/05</td><td>東証</td><td><a href="a.html">規程の改正</a> <a href="b.html">別紙</a></td></tr><tr><td>x</td><td></td><td>東証</td><td>リンクなし</td></tr></table>""",
    "rule_revisions": """<table><tr><th>公表日</th><th>内容</th><th>新旧</th></tr><tr><td>2024/3/1</td><td>上場規程</td><td><a href="/n.pdf">新旧</a></td></tr><tr><td>近日</td><td>他</td><td><a href="/m.pdf">新旧</a></td></tr></table>""",
    "safety_updates": """<ul>""" + "".join(f'<li><a href="{h}"><p class="date">{d}</p><p class="category x">{c}</p><p class="title">{t}</p></a></li>' for h, d, c, t in [
        ("1.html", "2024年1月10日", "安全", "回収"), ("1.html", "2024年1月10日", "安全", "回収"), ("2.html", "2024年1月11日", "審査", "承認"), ("3.html", "2021年1月1日", "安全", "古い"), ("4.html", "2024年13月1日", "安全", "日付なし")]) + "</ul>",
    "broker_comments": """<table><tr><td>案　件　名</td><td>募集期間</td></tr><tr><td><a href="r.pdf">規則</a></td><td>2024年1月5日から 2024年 2月5日まで</td></tr><tr><td><a href="s.pdf">細則</a></td><td>2024年1月5日から</td></tr></table>""",
    "broker_results": """<table><tr><td>公表日</td><td>案件名</td><td>募集期間</td></tr><tr><td>2024年3月1日</td><td><a href="q.pdf">結果</a>【資料】一覧</td><td>2024年1月5日～2024年2月5日</td></tr><tr><td></td><td><a href="z.pdf">他</a></td><td></td></tr></table>""",
    "court_decisions": """<table><tr><th>最高裁判例</th><td><p>損害賠償請求事件</p><p>令和5(受)1 令和6年1月9日 第三小法廷</p></td><td><a href="/x.pdf">全文</a><a href="/app/detail2/1.html">詳細</a></td></tr>
<tr><td><p>最高裁判例</p><p>令和6年2月30日</p></td><td><a href="/app/detail2/2.html">詳細</a></td></tr><tr><th>下級裁</th><td><p>他</p><p>令和6年1月9日</p><a href="/app/detail2/3.html">詳細</a></td></tr></table>""",
    "market_enforcement": """<ul><li>令和6年1月9日 <a href="a.html">課徴金納付命令の勧告について</a></li><li>令和6年1月9日 <a href="a.html">課徴金の勧告</a></li><li>令和6年1月10日 <a href="b.html">課徴金事例集</a></li>
<li>令和6年1月11日 <a href="c.html">証券モニタリング基本方針</a></li><li><a href="d.html">告発について</a></li><li>令和6年1月12日 <a href="e.html">人事</a></li></ul>""",
    "privacy_news": """<ul><li><time datetime="2024-01-09">1/9</time><div class="news-label-wrap"><span>お知らせ</span></div><div class="news-text"><a href="n.html">注意 喚起</a></div></li><li><a href="o.html">他</a></li></ul>""",
    "competition_news": """<ul class="list norcor"><li><a href="1.html">(令和6年1月9日) 排除措置命令</a></li><li><a href="2.html">確約計画</a></li></ul><ul><li><a href="3.html">他</a></li></ul>""",
    "environment_news": """<details><span class="p-press-release-list__heading">2024年1月9日発表</span><ul><li class="c-news-link__item"><span class="c-tag">水</span><a class="c-news-link__link" href="1.html">水質</a></li></ul></details>
<details><span class="p-press-release-list__heading">2024年2月31日発表</span><ul><li class="c-news-link__item"><a class="c-news-link__link" href="2.html">大気</a></li></ul></details>""",
    "transport_news": """<dl><dt>2024年1月9日</dt><dd><a href="/report/press/a_1.html">告示</a><a href="/report/press/houdou202401.html">一覧</a><a href="/other.html">他</a></dd>
<dt>2024年1月8日</dt><dd><a href="/report/press/a_1.html">再掲</a><a href="/report/press/b_2.html">省令</a></dd></dl><a href="/report/press/c_3.html">外</a>""",
    "economy_news": """<a href="/press/2024/0.html">先頭</a><h2>2024年1月9日</h2><a href="/press/2024/1.html">一</a><h2>2024年13月1日</h2><a href="/press/2024/2.html">二</a>
<time datetime="2024-01-07">7日</time><a href="/press/2024/3.html">三</a><a href="/press/index.html">索引</a><a href="/press/2024/1.html">再掲</a>""",
    "tax_news": """<table class="index_news"><tr><th>令和6年1月9日</th><td><a href="a.htm">通達</a><a href="b.htm">別</a></td></tr><tr><th>令和2年1月9日</th><td><a href="c.htm">古い</a></td></tr><tr><th>令和6年12月9日</th><td><a href="d.htm">先</a></td></tr></table>
<table class="index_news info-item"><tr><th>令和6年1月8日</th><td><a href="e.htm">旧</a></td></tr></table>""",
}
AT = "https://site.example"
WANT = {
    "bills": [("甲法案", AT + "/p/5.html", "閣法; 審議状況: 成立; 提出回次: 213; 番号: 5", "", None, "Enacted"), ("乙法案", BASE, "閣法; 審議状況: 提出; 提出回次: 213; 番号: 不明", "", None, "Bill Submitted")],
    "exchange_comments": [("規程の改正", AT + "/top/a.html", "JPX public comment; 法人: 東証; 募集期間: 2024-01-05～2024-02-05", "2024-01-05", "2024-02-05", None)],
    "rule_revisions": [("上場規程", AT + "/n.pdf", "東京証券取引所 規則改正新旧対照表", "2024-03-01", None, None)],
    "safety_updates": [("回収", AT + "/top/1.html", "PMDA 安全対策業務 新着情報", "2024-01-10", None, "Government Announcement")],
    "broker_comments": [("規則", AT + "/top/r.pdf", "JSDA public comment; 募集期間: 2024-01-05～2024-02-05", "2024-01-05", "2024-02-05", None)],
    "broker_results": [("結果", AT + "/top/q.pdf", "JSDA public comment results; 募集期間: 2024-01-05～2024-02-05", "2024-03-01", None, "Public Comment Results Published")],
    "court_decisions": [("損害賠償請求事件", AT + "/app/detail2/1.html", "令和5(受)1 令和6年1月9日 第三小法廷", "2024-01-09", None, "Court Decision")],
    "market_enforcement": [("課徴金納付命令の勧告について", AT + "/top/a.html", "SESC enforcement or securities market-monitoring policy update", "2024-01-09", None, "Enforcement Action"), ("証券モニタリング基本方針", AT + "/top/c.html", "SESC enforcement or securities market-monitoring policy update", "2024-01-11", None, None)],
    "privacy_news": [("注意 喚起", AT + "/top/n.html", "お知らせ", "2024-01-09", None, None)],
    "competition_news": [("排除措置命令", AT + "/top/1.html", "報道発表", "2024-01-09", None, None), ("確約計画", AT + "/top/2.html", "報道発表", None, None, None)],
    "environment_news": [("水質", AT + "/top/1.html", "水", "2024-01-09", None, None), ("大気", AT + "/top/2.html", "報道発表", None, None, None)],
    "transport_news": [("告示", AT + "/report/press/a_1.html", "報道発表", "2024-01-09", None, None), ("省令", AT + "/report/press/b_2.html", "報道発表", "2024-01-08", None, None)],
    "economy_news": [("先頭", AT + "/press/2024/0.html", "ニュースリリース", "", None, None), ("一", AT + "/press/2024/1.html", "ニュースリリース", "2024-01-09", None, None), ("二", AT + "/press/2024/2.html", "ニュースリリース", "2024-01-09", None, None), ("三", AT + "/press/2024/3.html", "ニュースリリース", "2024-01-07", None, None)],
    "tax_news": [("通達", AT + "/top/a.htm", "国税庁新着情報・通達等", "2024-01-09", None, None)],
}


@pytest.mark.parametrize("site", list(PAGES))
def test_site(spark, site):
    from tidemill.sources.sites import notices

    df = spark.createDataFrame([(1, PAGES[site]), (2, None), (3, "<p>nothing</p>"), (4, PAGES[site])], "page int, html string").repartition(2)
    rows = notices(df, "html", F.lit(BASE), ["page"], site, F.lit(dt.date(2024, 2, 1))).orderBy("page", "place").collect()
    for page in (1, 4):
        assert [(r["title"], r["link"], r["summary"], r["published"], r["deadline"], r["stage_hint"]) for r in rows if r["page"] == page] == WANT[site]
    assert {r["page"] for r in rows} == {1, 4}
