"""Pages written by hand after common site layouts, none of them by the operator's own generator:
(html, main blocks in page order)."""

PAGES = [
    # a blog with sidebar, byline and comments
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Sourdough at altitude – Crumb Diary</title><link rel=stylesheet href=/s.css>
<body class="post-template single"><a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><p class="site-title"><a href="/">Crumb Diary</a></p><nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li><a href="/about">About</a></li><li><a href="/recipes">Recipes</a></li><li><a href="/contact">Contact</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="primary" class="site-main"><article id="post-88" class="post hentry"><header class="entry-header"><h1 class="entry-title">Sourdough at altitude</h1></header>
<div class="entry-content"><p>When we moved to the mountains, my bread stopped rising the way it used to.</p><p>Water boils earlier up here, and dough dries out faster. It took me two winters to learn what to change.</p><h2>What to change</h2><ul><li>Use less starter, about fifteen percent.</li><li>Add a little more water.</li></ul><blockquote><p>Trust the dough, not the clock.</p></blockquote><p>Happy baking!</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment"><p>Thanks, this saved my weekend loaf.</p></li><li class="comment"><p>Does it work with rye flour too?</p></li></ol><form id="commentform" class="comment-form"><p>Your email address will not be published.</p><input type=submit value="Post Comment"></form></div></main>
<aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/1">Rye and patience</a></li><li><a href="/2">A better crumb</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info"><a href="/wp">Proudly powered by a blog engine</a></div></footer></body></html>""",
        ["Sourdough at altitude", "When we moved to the mountains, my bread stopped rising the way it used to.", "Water boils earlier up here, and dough dries out faster. It took me two winters to learn what to change.", "What to change", "Use less starter, about fifteen percent.", "Add a little more water.", "Trust the dough, not the clock.", "Happy baking!"],
    ),
    # a news site with a cookie notice, an advert in the text and related links
    (
        """<html><head><title>Council votes on bridge</title><script>window.dataLayer=[];</script></head><body><div id="cookie-banner" class="cookie-consent"><p>We use cookies to improve your experience.</p><button>Accept all</button></div>
<div class="top-bar"><ul class="menu"><li><a href="/w">World</a><li><a href="/s">Sport</a><li><a href="/c">Culture</a></ul></div>
<article class="story"><h1>Council votes to rebuild the old bridge</h1><p>The town council voted on Tuesday to rebuild the bridge that closed in March.</p><div class="ad-slot advertisement"><p>Sponsored: the best mattress of the year.</p></div><p>Work is expected to begin in autumn and to take eighteen months.</p><p>&ldquo;We have waited long enough,&rdquo; said one resident, who crosses the river every day.</p><div class="share-buttons social"><ul><li><a href="#">Share</a></li><li><a href="#">Post</a></li></ul></div></article>
<section class="related"><h3>Related stories</h3><ul><li><a href="/a">Ferry fares rise again</a></li><li><a href="/b">Ten years of roadworks</a></li></ul></section>
<footer><p>© 2024 Valley Courier. All rights reserved.</p></footer></body></html>""",
        ["Council votes to rebuild the old bridge", "The town council voted on Tuesday to rebuild the bridge that closed in March.", "Work is expected to begin in autumn and to take eighteen months.", "“We have waited long enough,” said one resident, who crosses the river every day."],
    ),
    # reference documentation with code and a table
    (
        """<!DOCTYPE html><html><head><title>sort()</title></head><body><nav class="sidebar-nav" aria-label="docs"><a href="/map">map()</a> <a href="/filter">filter()</a> <a href="/reduce">reduce()</a></nav>
<main id="docs-content"><h1>sort()</h1><p>The sort() method puts the elements of a list in order and returns the list.</p><h2>Syntax</h2><pre>list.sort()
list.sort(compare)</pre><h2>Parameters</h2><dl><dt>compare</dt><dd>A function that says which of two elements comes first.</dd></dl><table><tr><th>Version</th><th>Change</th></tr><tr><td>3.0</td><td>The sort became stable.</td></tr></table></main>
<footer class="page-footer"><a href="/edit">Edit this page</a><a href="/report">Report a problem</a></footer></body></html>""",
        ["sort()", "The sort() method puts the elements of a list in order and returns the list.", "Syntax", "list.sort() list.sort(compare)", "Parameters", "compare", "A function that says which of two elements comes first.", "Version", "Change", "3.0", "The sort became stable."],
    ),
    # an encyclopedia entry
    (
        """<html><head><title>Otter</title></head><body><div id="siteNotice" class="notice">Help us reach our goal this spring.</div><div id="content" class="page-body" role="main"><h1 id="firstHeading">Otter</h1><div id="bodyContent"><p>Otters are mammals that live in and near <a href="/water">water</a>.</p><p>They eat fish, frogs and crayfish, and they are known for their <a href="/play">playful</a> behaviour.</p><h2>Habitat</h2><p>Most kinds live along rivers; the sea otter lives along coasts.</p></div></div>
<div id="navigation" class="portal"><ul><li><a href="/main">Main page</a></li><li><a href="/random">Random article</a></li></ul></div><div id="footer"><ul><li>This page was last edited on 4 May.</li><li><a href="/privacy">Privacy policy</a></li></ul></div></body></html>""",
        ["Otter", "Otters are mammals that live in and near water.", "They eat fish, frogs and crayfish, and they are known for their playful behaviour.", "Habitat", "Most kinds live along rivers; the sea otter lives along coasts."],
    ),
    # no wrapper at all, tags left open
    (
        """<title>My trip</title><h1>My trip to the lake</h1><p>We left at dawn, before the heat, and drove north for three hours.<p>The lake was calm &amp; cold.<p>Nobody else was there until noon, and we swam to the island and back.""",
        ["My trip to the lake", "We left at dawn, before the heat, and drove north for three hours.", "The lake was calm & cold.", "Nobody else was there until noon, and we swam to the island and back."],
    ),
    # a shop's guide, with a newsletter form and breadcrumbs
    (
        """<html><body><div class="breadcrumbs"><a href="/">Home</a> / <a href="/g">Guides</a> / Tents</div><div class="content article-body"><h1>How to choose a tent</h1><p>A good tent keeps out the rain, stands up to wind and is light enough to carry.</p><ol><li>Decide how many people will sleep in it.</li><li>Look at the weight before the price.</li></ol><p>Three-season tents are right for most people.</p></div><div class="newsletter-signup"><form action=/n><label>Get our newsletter</label><input name=e><button>Subscribe</button></form></div><div class="footer-links"><a href=/r>Returns</a><a href=/j>Jobs</a></div></body></html>""",
        ["How to choose a tent", "A good tent keeps out the rain, stands up to wind and is light enough to carry.", "Decide how many people will sleep in it.", "Look at the weight before the price.", "Three-season tents are right for most people."],
    ),
    # only navigation and legal lines: no article
    (
        """<html><body><nav><ul><li><a href=/a>Archive</a></li><li><a href=/b>Tags</a></li></ul></nav><footer class="footer"><p>© Some Company. <a href=/t>Terms</a></p></footer></body></html>""",
        [],
    ),
    # a magazine: figure, pull quote, author box, comments under another name
    (
        """<html><head><title>The night train</title><noscript><img src=pixel.gif></noscript></head><body><header class="branding"><a href="/">Meridian</a><nav class="topbar"><a href=/e>Essays</a><a href=/f>Fiction</a></nav></header><main><article class="post"><h1>The night train</h1><p>It leaves the harbour station at ten past eleven, with nine cars and no dining room.</p><figure><img src=t.jpg alt=""><figcaption>The train at the border.</figcaption></figure><p>I have taken it every winter since my father died.</p><p>There is a way of sleeping on it that one has to learn: shoes on, bag under the knees.</p></article><div class="author meta"><p>Ines Vale writes about rail.</p></div><section class="responses"><h3>Responses</h3><div class="response"><p>Lovely. I took that train in 1998.</p></div></section></main><footer><p>Meridian is printed four times a year.</p></footer></body></html>""",
        ["The night train", "It leaves the harbour station at ten past eleven, with nine cars and no dining room.", "The train at the border.", "I have taken it every winter since my father died.", "There is a way of sleeping on it that one has to learn: shoes on, bag under the knees."],
    ),
]
