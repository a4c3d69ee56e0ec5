"""Labelled pages from which the weights of the extraction are learnt.

The article of each stands between `<!--main-->` and `<!--/main-->`. A bounded sample, given as a parameter of
the extraction; other pages can be given in its place.
"""

PAGES = [
    """<!DOCTYPE html><html><head><title>River floods</title><style>p{margin:0}</style></head><body><header><a href="/">Daily</a>
    <nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul></nav></header>
    <article><!--main--><h1>River floods the old town</h1><p>The river rose by two metres on Monday night and reached the market
    square before dawn, the fire service said.</p><p>Nobody was hurt. <b>Two bridges</b> stay closed until the end of the week.</p>
    <ul><li>The school opens again on Thursday.</li><li>Buses run every hour.</li></ul><!--/main--></article>
    <div class="related"><h3>Read more</h3><a href="/1">Last year's flood</a> <a href="/2">Bridges of the county</a></div>
    <footer>&copy; Daily &middot; <a href="/i">Imprint</a> <a href="/p">Privacy</a></footer></body></html>""",
    """<html><body><div id="top-menu"><a href="/">Home</a> | <a href="/blog">Blog</a> | <a href="/about">About</a></div>
    <div class="cookie-notice">We use cookies to make this site better. <button>Accept</button></div>
    <div class="post"><!--main--><h2>How to sharpen a plane</h2><p>Start with a flat stone and a little oil. Hold the blade at
    thirty degrees and draw it towards you.</p><p>Turn it over after a dozen strokes and take off the burr.<br>Test it on end
    grain.</p><blockquote>A dull tool is a dangerous tool.</blockquote><!--/main--></div>
    <div class="comments"><h3>3 comments</h3><div class="comment"><p>Great tip, thanks, I will try it on my old jack plane.</p></div>
    <div class="comment"><p>What stone do you use?</p></div></div>
    <div class="sidebar"><h3>Tags</h3><ul><li><a href="/t/1">wood</a></li><li><a href="/t/2">tools</a></li></ul></div></body></html>""",
    """<html><body><table><tr><td class="left"><a href="/a">Index</a><br><a href="/b">Search</a><br><a href="/c">Links</a></td>
    <td><!--main--><h1>Catalogue of mosses</h1>This page lists the mosses found on the north wall since 1987.<p>Most of them grow
    in the shade of the chapel, where the mortar is soft and stays wet through the summer.<p>See the <a href="/m">map</a> for the
    places named in the text.<!--/main--></td></tr></table><hr>Last changed 3 May. <a href="/mail">Contact</a></body></html>""",
    """<html><body><nav><a href="/">Docs</a><a href="/api">API</a></nav><aside><ul><li><a href="#a">Install</a></li><li>
    <a href="#b">Use</a></li><li><a href="#c">Options</a></li></ul></aside><main><!--main--><h1>Install</h1><p>Unpack the archive
    and run the script in it. It asks for a folder and copies two files there.</p><pre>unpack archive
    ./install</pre><h2>Use</h2><p>Call the program with the name of a table. The result goes to the same folder.</p><table><tr>
    <td>-q</td><td>says nothing</td></tr><tr><td>-n</td><td>changes nothing</td></tr></table><!--/main--></main>
    <form><label>Was this page helpful?</label><input type="radio"> Yes <input type="radio"> No <button>Send</button></form>
    <footer>Version 2 <a href="/licence">Licence</a></footer></body></html>""",
    """<html><body><div class="header"><img src="l.png"><form action="/s"><input name="q"><button>Search</button></form></div>
    <div class="ad">Half price on all garden chairs this week only.</div><div class="story"><!--main--><h1>Council votes</h1>
    <p>The council voted nine to four for the new tram line after a debate of six hours.</p><p>Work begins in spring. The line
    will join the station with the hospital and the two schools in the east.</p><p>Opponents said the cost was too high.</p>
    <!--/main--></div><div class="share"><a href="#">Share</a> <a href="#">Send</a></div><div class="newsletter">Sign up for our
    letter <form><input name="mail"><button>Go</button></form></div><ul class="footer-links"><li><a href="/t">Terms</a></li><li>
    <a href="/c">Contact</a></li></ul></body></html>""",
    """<html><body><div class="breadcrumb"><a href="/">Start</a> &gt; <a href="/r">Recipes</a></div><section><!--main--><h1>Leek soup
    </h1><p>Enough for four. Wash the leeks well and cut them into rings.</p><ol><li>Melt the butter and cook the leeks until soft.
    </li><li>Add potatoes and stock, and simmer for twenty minutes.</li><li>Season with nutmeg.</li></ol><p>Serve with bread.</p>
    <!--/main--></section><section class="recommended"><h4>You may also like</h4><a href="/1">Onion tart</a><a href="/2">Bread</a>
    </section><script>track();</script></body></html>""",
]
