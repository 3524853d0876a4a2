"""The seed of the labelled sample for page boilerplate: what web pages of any site put around a text, what editors note on one, and prose with words of pages.

Written from general knowledge of web pages in the three languages of the
library; page_body adds the lines that sites of the corpus repeat.
"""

from __future__ import annotations

# Labelled lines.
AROUND = """
您现在的位置：网站首页 >> 资讯 >> 正文
当前位置: 主页 > 资料 > 详情
网站首页 | 新闻 | 论坛 | 下载 | 留言板 | 登录 | 注册
首页 - 检索 - 专题 - 人物 - 地图
关于我们 / 联系我们 / 网站地图 / 会员中心 / 投稿
上一篇：
下一篇：
上一篇：没有了
« 上一页 目录 下一页 »
« 上一章 | 回目录 | 下一章 »
« 上一章 / 回目录 / 下一章 »
« 上一章 - 回目录 - 下一章 »
« 上一章 · 回目录 · 下一章 »
« 上一章  回目录  下一章 »
« 返回列表 »
回目录
相关阅读：
相关文章：更多 > >
热门推荐 ① ② ③
本周热门 排行榜 推荐阅读
标签：
关键词：
订阅我们的电子简报，每天一封
本网站使用 Cookie 以改善您的浏览体验，继续浏览即视为同意我们的隐私政策。
我们尊重您的隐私，只收集必要的数据。全部接受 全部拒绝 更多设置
为了保存您的偏好，浏览器会记录本地数据。[知道了]
字体大小：小 中 大　夜间模式
【打印】【关闭】【收藏本页】
打印文章　关闭窗口　返回顶部
报告错误 加入收藏 语音朗读
分享到：微信 微博 空间 复制网址
扫描二维码，在手机上打开
点击转发，分享给好友
喜欢就点赞、转发并关注公众号
浏览：0 次　评论：0 条
阅读量：0　点击数：0
您是本页第 0 位访问者，自 0 年起累计访问 0 次
暂时没有评论，快来发表评论
责任编辑：管理员
来源：本站 · 编辑：小组
录入：网友　校对：志愿者
本文由志愿者整理上传，仅供学习交流，不得用于商业用途。
版权所有，未经授权不得转载。
转载本站文章请注明来源，版权归原作者所有。
版权声明 免责声明 网站底部
备案号：第0号　违法和不良信息举报
广告 ——
页面加载中，请等待……
网页显示不正常？请刷新页面或更换浏览器
网站改版，旧地址将自动跳转到新版
建议使用大屏幕浏览本站
注册会员可下载全文
读者来信请寄编辑部，投稿有酬
本站招募志愿编辑，有兴趣者请联系
更多内容请点此查看本栏目专题页
Sie befinden sich hier: Startseite / Archiv
Startseite | Suche | Hilfe | Kontakt | Impressum
Anmelden · Gästebuch · Spenden · Themen · Über uns
Diese Website verwendet Cookies. Alle zulassen / Alle ablehnen
Datenschutz: Wir speichern Ihre Einstellungen. Akzeptieren
Artikel teilen: Link kopieren, per E-Mail senden
Siehe auch: ähnliche Beiträge
« Zurück
Zurück: Inhaltsverzeichnis
Weiter: nächste Seite »
Schlagworte: Stichwörter:
Seite drucken · Fenster schließen · Nach oben
Seitenaufrufe: 0
Aufrufe heute: 0
© Archiv. Alle Rechte vorbehalten, nur für den privaten Gebrauch.
Von Freiwilligen eingegeben, nur zum Studium freigegeben.
Erfasst von unserer Redaktion
Werbung
You are here: Home / Archive
Home | Search | Help | Contact | Topics
Login - About - Guestbook - Donate - Register
We use cookies on this website. Accept all / Reject all
This site stores your preferences. Decline
Share this article: copy link, send by e-mail
See also: related articles
Previous: table of contents
Next: page »
Tags:
Keywords:
Print this page | Close window | Back to top
Views of this page: 0
Visitors since 0: 0
Back to index
© Library. All rights reserved, for private study only.
Transcribed by volunteers of the archive
Advertisement
"""

NOTES = """
（据手稿刊印，标点为编者所加）
（译自初版，旧式标点未改）
按：本文依初版校订，文字从旧。
按：原稿无标题，今题由编者拟定。
校记：本篇异文见附注。
【编者注】此处原稿缺页，题目后补。
【译者注】原文如此。
（作者原注）
Nach der Handschrift gedruckt.
Der Text folgt der Erstausgabe, dem ersten Druck.
Anmerkung des Herausgebers: ohne Titel.
The text is that of the first edition.
Text follows the manuscript and the first printing.
Note by the editor: untitled in the original.
"""

PROSE = """
秘书打印了一份决议，把它转发给各地的会员。
这一期杂志的首页刊登了他的评论，封底写着版权所有。
他喜欢收藏旧地图，常与朋友分享，也请他们转告读者。
编辑部收到许多读者来信，志愿者逐一登记，寄回原处。
他关注下一篇论文，点头称赞，浏览之后关闭了门窗。
检索目录的人访问了图书馆，并联系了管理员。
Er teilte die Seiten mit seinen Freunden, druckte sie und suchte Hilfe.
She searched the page for help and shared the printing with her friends at home.
"""


def lines(sample: str) -> list[tuple[str, float]]:
    """(line, weight) of a sample: every line counts the same."""
    return [(line, 1.0) for line in sample.split("\n") if line]
