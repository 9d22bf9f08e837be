"""Labelled pages from which the weights of words and tags are learned.

Whole pages of common makes, whose main text stands between ``[[`` and ``]]``.  Of
their texts only the number of words and the sentence end matter, so ``{40}``
stands for forty words with a full stop and ``{3-}`` for three without one.
:func:`mark` labels further pages by their structure, with a bounded number of them.
"""

from __future__ import annotations

import re

PAGES = (
    # a newspaper
    """<html><body><header class="site-header"><a href="/" class="logo">{2-}</a><p class="claim">{6-}</p></header>
    <nav class="main-nav"><ul class="menu"><li><a href="1">{1-}</a></li><li><a href="2">{2-}</a></li><li><a href="3">{1-}</a></li><li><a href="4">{1-}</a></li><li><a href="5">{2-}</a></li></ul></nav>
    <div class="cookie-notice"><p>{18}</p><button>{1-}</button></div><div class="ad">{14}</div><div class="ad">{5}</div>
    <article>[[<h1>{9-}</h1><p><b>{22}</b></p><p>{60}</p><p>{14}</p><p>{23}</p><p>{7}</p><p>{4}</p><p>{71} <a href="x">{3-}</a> {20}</p>]]<div class="ad">{12}</div>[[<h2>{4-}</h2><p>{55}</p><p>{11}</p><p>{18}</p><p>{2}</p>
    <ul><li>{6-}</li><li>{9-}</li><li>{3-}</li></ul><figure><img src="a"><figcaption>{10}</figcaption></figure><blockquote><p>{25}</p></blockquote><p>{48}</p><p>{19}</p><p>{33}</p>]]<div class="share-buttons"><a>{1-}</a><a>{1-}</a></div></article>
    <aside class="sidebar"><h3>{2-}</h3><ul><li><a href="s">{6-}</a></li><li><a href="t">{7-}</a></li><li><a href="u">{5-}</a></li></ul><p>{16}</p></aside>
    <section class="comments" id="comments"><h2>{2-}</h2><div class="comment"><p>{25}</p></div><div class="comment"><p>{41}</p></div><div class="comment"><p>{9}</p></div></section>
    <form class="newsletter"><label>{6-}</label><p>{8}</p></form><footer><p>{14}</p><ul><li><a>{2-}</a></li><li><a>{1-}</a></li></ul>{10-}</footer></body></html>""",
    # a weblog without sectioning elements
    """<html><body><div id="header"><h1><a href="/">{3-}</a></h1><p>{5-}</p></div><div class="ad"><p>{4}</p></div><div class="menu"><a href="1">{1-}</a> <a href="2">{1-}</a> <a href="3">{2-}</a> <a href="4">{1-}</a></div>
    <div id="content"><div class="post">[[<h2>{7-}</h2><div class="entry-content"><p>{50}</p><p>{15}</p><p>{5}</p><p>{63} <i>{3-}</i> {12}</p><ol><li>{12}</li><li>{9}</li><li>{14}</li></ol><pre><code>{20-}</code></pre><p>{44}</p><p>{21}</p><p>{17}</p><p>{38}</p></div>]]
    <div class="post-meta">{5-} <a href="c">{1-}</a></div><div class="social-links"><a>{1-}</a><a>{1-}</a><a>{1-}</a></div><div class="related-posts"><h3>{2-}</h3><ul><li><a href="r">{6-}</a></li><li><a href="q">{5-}</a></li></ul></div></div>
    <div class="navigation"><a href="p">{3-}</a><a href="n">{3-}</a></div><div id="comments"><h3>{2-}</h3><ol class="commentlist"><li><div class="comment-body"><p>{30}</p></div></li><li><div class="comment-body"><p>{22}</p><p>{13}</p></div></li></ol>
    <div id="respond"><form><p>{5-}</p><label>{2-}</label><p>{4-}</p></form></div></div></div>
    <div id="sidebar"><div class="widget"><h4>{2-}</h4><ul><li><a>{3-}</a></li><li><a>{2-}</a></li><li><a>{4-}</a></li></ul></div><div class="widget"><p>{20}</p></div></div><div id="footer"><p>{12}</p></div></body></html>""",
    # a magazine: banners and promotions inside main
    """<html><body><div class="top-banner"><a href="b">{8-}</a></div><div class="consent-banner" role="dialog"><p>{30}</p></div><header><nav role="navigation"><a>{1-}</a><a>{1-}</a><a>{2-}</a></nav><p>{8-}</p></header>
    <main>[[<h1>{8-}</h1><p>{55}</p><p>{11}</p><p>{18}</p><p>{47} <em>{2-}</em> {6}</p><h3>{5-}</h3><p>{3}</p><p>{58}</p>]]<div class="advertisement"><p>{15}</p></div>[[<p>{49}</p>]]<aside><p>{20}</p></aside>[[<section><h3>{4-}</h3><p>{40}</p><p>{13}</p><p>{52}</p><p>{12}</p></section>]]<div class="promo"><p>{14}</p><a>{2-}</a></div>
    [[<table><tr><th>{2-}</th><th>{1-}</th></tr><tr><td>{3-}</td><td>{1-}</td></tr><tr><td>{4-}</td><td>{2-}</td></tr></table><p>{37}</p>]]<form class="subscribe"><p>{12}</p><label>{2-}</label></form></main>
    <div class="recommended"><div class="teaser"><h3><a href="1">{7-}</a></h3><p>{18}</p></div><div class="teaser"><h3><a href="2">{8-}</a></h3><p>{16}</p></div><div class="teaser"><h3><a href="3">{6-}</a></h3><p>{19}</p></div></div>
    <footer class="site-footer"><ul><li><a>{2-}</a></li><li><a>{2-}</a></li></ul><div class="copyright">{10-}</div></footer><div class="legal"><p>{25}</p></div></body></html>""",
    # an encyclopedia
    """<html><body><div id="siteNotice"><div>{20}</div></div><div id="content"><div class="toolbar"><a>{2-}</a><a>{1-}</a><a>{2-}</a></div>[[<h1>{3-}</h1><div id="bodyContent"><p>{65} <a href="a">{2-}</a> {11}</p><p>{72}</p><h2>{3-}</h2><p>{48} <a href="b">{1-}</a> {20}</p>
    <ul><li>{9} <a href="c">{2-}</a></li><li><a href="d">{3-}</a></li><li><a href="e">{4-}</a> {7}</li></ul><h4>{3-}</h4><p>{29}</p><h4>{2-}</h4><p>{80}</p><p>{22}</p><p>{6}</p><p>{14}</p><dl><dt>{2-}</dt><dd>{12}</dd><dt>{1-}</dt><dd>{15}</dd></dl><p>{61}</p><p>{24}</p><p>{10}</p></div>]]</div>
    <div id="panel"><div class="portal"><ul><li><a>{2-}</a></li><li><a>{3-}</a></li><li><a>{2-}</a></li></ul></div></div><ul class="breadcrumbs"><li><a>{1-}</a></li><li><a>{2-}</a></li></ul><div id="footer"><ul><li>{8}</li><li>{6}</li></ul></div></body></html>""",
    # an old page laid out with a table
    """<html><body><table class="nav"><tr><td><a href="1">{2-}</a></td><td><a href="2">{1-}</a></td><td><a href="3">{2-}</a></td></tr></table><center>[[<h1>{6-}</h1></center><p>{60}<p>{54}<br>{20}<p><b>{3-}</b> {41}<h2>{4-}</h2><p>{66}<hr><h4>{2-}</h4><p>{5}<address>{4-}</address><center>{3-}</center><p>{47}]]
    <form action="s"><p>{6-}</p></form><div class="banner"><a href="z">{5-}</a></div><div class="footer">{15-}</div></body></html>""",
    # text straight in the body, and in divisions
    """<html><body>[[{30} {45}<br><br>{38}<br>{52}]]<hr><address>{6-}</address></body></html>""",
    """<html><body><div class="nav"><a>{1-}</a><a>{2-}</a><a>{1-}</a></div><div class="ad">{6}</div><div class="ads">{9}</div><div class="text">[[<div>{45}</div><div>{52}</div><div>{8}</div><div>{60}</div><div>{39}</div>]]</div><div class="copyright">{9-}</div></body></html>""",
    """<html><body><div class="ad">{7}</div>[[<p>{21}</p><p>{34}</p><p>{18}</p>]]<div class="advert">{11}</div></body></html>""",
    """<html><body><nav><a>{1-}</a></nav><div class="ad">{5}</div><article>[[<h1>{1-}</h1><p>{2}</p>]]</article><footer>{6}</footer></body></html>""",
    """<html><body><main>[[<p>{3}</p><p>{9}</p>]]<div class="ad">{8}</div>[[<p>{4}</p>]]</main><div class="ad">{12}</div></body></html>""",
    """<html><body>[[<h1>{4-}</h1>{40}<p>{34}</p>{18}]]</body></html>""",
    """<html><body><div class="wrap"><div class="col">[[<div><h2>{5-}</h2><div><p>{31}</p><p>{12}</p></div></div><div><div><p>{44}</p></div><div><p>{6}</p><p>{27}</p></div></div><div><h3>{3-}</h3><p>{35}</p></div>]]</div><div class="rail"><a>{4-}</a></div></div></body></html>""",
    # a shop
    """<html><body><div class="masthead"><a>{2-}</a></div><div class="searchbox"><form><label>{2-}</label></form></div><div class="login"><form><p>{4-}</p></form></div><ul class="nav"><li><a>{2-}</a></li><li><a>{1-}</a></li><li><a>{2-}</a></li></ul>
    <div class="main"><div class="article-body">[[<h1>{6-}</h1><p>{45}</p><p>{16}</p><p>{8}</p><p>{51}</p><ul><li>{9}</li><li>{7-}</li><li>{11}</li></ul><p>{40}</p><p>{13}</p>]]</div><div class="sponsored-box"><p>{15}</p></div><div class="newsletter-signup"><p>{14}</p></div></div>
    <div class="reviews"><h3>{2-}</h3><div class="review"><p>{25}</p></div><div class="review"><p>{31}</p></div></div><div class="sidebar"><div><p>{15}</p></div></div><div class="popup"><p>{12}</p></div><div class="modal"><div><p>{14}</p></div></div><div class="tags"><a>{1-}</a><a>{1-}</a></div>
    <div class="pagination"><a>{1-}</a><a>{1-}</a></div><footer><nav><a>{2-}</a><a>{1-}</a></nav></footer></body></html>""",
    # an article with much that is no article inside of it
    """<html><body><div class="skip-link"><a>{4-}</a></div><article><nav class="toc"><ul><li><a>{2-}</a></li><li><a>{3-}</a></li></ul></nav>[[<header><h1>{8-}</h1><p>{7}</p></header><section><p>{55}</p><p>{11}</p><p>{18}</p><p>{49}</p>]]<div class="notice"><p>{20}</p></div>[[<p>{40}</p><p>{13}</p><p>{3}</p></section>]]
    <div class="xk-slot">{13}</div>[[<p>{61}</p><p>{24}</p><p>{10}</p>]]<aside class="box"><p>{24}</p><p>{11}</p></aside>[[<p>{52}</p><p>{12}</p><p>{44}</p><p>{21}</p><p>{17}</p>]]<div><a href="k">{9-}</a></div>[[<p>{47}</p><p>{1}</p><p>{15}</p><p>{2}</p>]]<form><p>{8}</p><label>{3-}</label></form><footer>{10-}<p>{9}</p></footer>
    <div class="comments"><h3>{2-}</h3><p>{20}</p><p>{34}</p></div></article><section id="comments"><article class="comment"><p>{27}</p></article><article class="comment"><p>{18}</p></article></section></body></html>""",
    """<html><body><div class="alert">{14}</div><div class="page"><div class="container"><div class="row"><article class="story"><header>[[<h1>{7-}</h1></header><div class="lead">{24}</div><div class="story-text"><p>{42}</p><p>{58}</p><p>{1}</p><p>{46}</p></div>]]<div class="ad-slot">{12}</div><div class="ad-box"><p>{16}</p></div>
    [[<div class="story-text"><p>{50}</p><p>{15}</p><p>{5}</p><p>{39}</p></div>]]<section class="comments"><p>{20}</p><p>{25}</p></section></article></div></div></div><div class="overlay"><p>{13}</p></div><div class="cookie-banner">{20}</div><div role="contentinfo"><p>{12}</p></div></body></html>""",
    # a review whose ratings and boxes stand in the text, without helpful names
    """<html><body><div><ul><li><a>{1-}</a></li><li><a>{1-}</a></li><li><a>{2-}</a></li></ul></div><main><article>[[<h1>{5-}</h1><div class="intro">{19}</div><p>{44}</p><p>{21}</p><p>{17}</p>]]<div>{11}</div>[[<p>{57}</p><h2>{3-}</h2><p>{62}</p>]]<div>{16}</div>[[<p>{51}</p><ol><li>{5-}</li><li>{8}</li></ol><p>{40}</p><p>{13}</p>]]</article></main>
    <div><p>{12}</p><a>{3-}</a></div><div><div><h4><a href="1">{6-}</a></h4><p>{13}</p></div><div><h4><a href="2">{7-}</a></h4><p>{12}</p></div></div><ul class="comments"><li>{25}</li><li>{14}</li></ul></body></html>""",
    # a forum's opening text, the replies below
    """<html><body><div class="topbar"><a>{1-}</a><a>{2-}</a></div><div class="breadcrumb"><a>{1-}</a><a>{2-}</a></div><div class="topic">[[<h1>{7-}</h1><div class="body"><p>{64}</p><p>{38}</p><p>{45}</p><p>{16}</p><p>{8}</p></div>]]</div><div class="replies"><div class="reply"><p>{30}</p></div><div class="reply"><p>{22}</p></div><div class="reply"><p>{12}</p></div></div>
    <aside><div class="widget"><ul><li><a>{3-}</a></li></ul></div><p>{20}</p></aside><footer><div><p>{16}</p></div><form><label>{4-}</label></form></footer></body></html>""",
    # documentation: a menu of many entries beside a long text
    """<html><body><aside class="menu"><nav><ul><li><a>{1-}</a><ul><li><a>{2-}</a></li><li><a>{2-}</a></li></ul></li><li><a>{3-}</a></li></ul></nav></aside><main role="main"><div class="docs">[[<h1>{3-}</h1><div class="summary">{16}</div><div class="lead">{12}</div><p>{31}</p><pre>{24-}</pre><p>{27} <a href="x">{2-}</a> {4}</p><h2>{3-}</h2><ul><li>{8} <a href="y">{1-}</a></li><li>{6-}</li></ul>
    <table><tr><td>{2-}</td><td>{9}</td></tr><tr><td>{1-}</td><td>{12}</td></tr></table><p>{46}</p>]]</div><div class="pager"><a>{2-}</a><a>{2-}</a></div></main><footer class="footer"><p>{9-}</p></footer></body></html>""",
    # boxes between paragraphs, and replies below, that only their shape tells
    """<html><body><div class="qa"><a>{2-}</a></div><main>[[<h1>{6-}</h1><p>{48}</p><p>{31}</p>]]<div class="qb"><p>{11}</p></div>[[<p>{52}</p><p>{20}</p><p>{17}</p>]]<div class="qc"><div><p>{14}</p></div></div>[[<p>{44}</p><blockquote><p>{15}</p></blockquote><p>{6}</p>]]
    <div id="qd"><div class="qe"><p>{12}</p></div><div class="qe"><p>{25}</p><p>{9}</p></div><div class="qe"><p>{7}</p></div><div class="qe"><p>{18}</p></div></div></main><div class="qf">{9-}</div></body></html>""",
    """<html><body><article>[[<h1>{8-}</h1><div class="ra">{21}</div><p>{39}</p><p>{42}</p>]]<section class="rb"><h4>{3-}</h4><p>{19}</p></section>[[<p>{61}</p><p>{12}</p>]]<div class="rc"><p>{16}</p></div>[[<p>{33}</p><ul><li>{8}</li><li>{5}</li><li>{11}</li></ul><p>{27}</p>]]</article>
    <div class="rd"><section class="re"><p>{22}</p></section><section class="re"><p>{13}</p></section><section class="re"><p>{31}</p></section></div></body></html>""",
    """<html><body><div class="sa">[[<h2>{5-}</h2><p>{40}</p>]]<div class="sb">{12}</div>[[<p>{57}</p><p>{24}</p><p>{30}</p><p>{9}</p>]]</div><ol class="sc"><li class="sd"><p>{20}</p></li><li class="sd"><p>{11}</p></li><li class="sd"><p>{29}</p></li></ol></body></html>""",
    # nothing but a menu, nothing but a form
    """<html><body><nav><a>{2-}</a><ul><li><a>{1-}</a></li></ul></nav></body></html>""",
    """<html><body><form><label>{2-}</label><p>{4-}</p></form><div hidden>{30}</div><div style="display:none"><p>{30}</p></div><p hidden>{20}</p></body></html>""",
)

#: Elements that :func:`mark` takes for the article, and those inside of it that are none.
WHOLE, ASIDE = "article", frozenset("nav aside footer form".split())

_STAND_IN = re.compile(r"\{(\d+)(-?)\}")


def page_text(page: str) -> str:
    """The page with words for its stand-ins."""
    return _STAND_IN.sub(lambda m: " ".join(["word"] * int(m[1])) + ("" if m[2] else "."), page)


def mark(page: str) -> str | None:
    """A page with exactly one ``article`` element, its text marked as main text but
    for menus, asides, footers and forms in it; None for any other page."""
    low = page.lower()
    tags = list(re.finditer(r"<(/?)([a-z][a-z0-9]*)(?=[\s/>])[^>]*>", low))
    own = [m for m in tags if m[2] == WHOLE]
    if "[[" in page or "]]" in page or [m[1] for m in own] != ["", "/"]:
        return None
    at, depth, out = own[0].end(), 0, [page[: own[0].end()], "[["]
    for m in tags:
        if m[2] not in ASIDE or not own[0].end() <= m.start() < own[1].start():
            continue
        if not m[1]:
            if not depth:
                out += [page[at : m.start()], "]]"]
                at = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out += [page[at : m.end()], "[["]
                at = m.end()
    if depth:
        return None
    return "".join([*out, page[at : own[1].start()], "]]", page[own[1].start() :]])
